"""License scanning by template-markup matching.

A template is a text of words with two kinds of markup:

* ``<<optional>> ... <</optional>>``: a region that may be left out,
* ``<<any:LOW-HIGH>>``: a region replaced by LOW to HIGH words of any kind.

It is compiled to a token automaton: a word leads from a state to the next,
optional regions are skipped by empty moves, replaceable regions are chains of
states that any word advances. A text is accepted at a place if the automaton
reaches its end from there, that is, if all mandatory wording is there exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row

# The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Whole license texts in the markup above. What an owner fills in is replaceable, what versions leave out optional.
TEXTS = (
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<optional>> and associated
        documentation files (the "Software") <</optional>>, to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>> (including the next paragraph) <</optional>> shall be
        included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any:1-8>> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<any:1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any:1-8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<any:0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. <<any:0-1>> Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<optional>> <<any:0-1>> Neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. <</optional>>
        THIS SOFTWARE IS PROVIDED BY <<any:1-8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:1-8>> BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<any:0-1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
        you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<any:0-1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. <<any:0-1>> This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "apache-2-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any:1-4>> except in compliance with the
        License. You may obtain a copy of the License at <<any:1-12>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
)

# Sentences that name a license, in the same markup.
NOTICES = (
    ("mit-notice", "<<optional>> this <<any:1-3>> is <</optional>> licensed under the mit license"),
    ("apache-2-notice", "licensed under the apache license version 2 <<optional>> 0 <</optional>> <<optional>> the license <</optional>>"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("gpl-notice", "<<optional>> under the terms of the <</optional>> gnu general public license <<optional>> as published by <<any:1-6>> <</optional>> version <<any:1-1>>"),
    ("cc-by-nc-notice", "licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> cc by nc <<optional>> sa <</optional>> <<optional>> nd <</optional>> <<any:0-2>> <<optional>> license <</optional>>"),
    ("cc-notice", "licensed under a creative commons attribution <<optional>> noncommercial <</optional>> <<any:0-3>> license"),
    ("reserved-notice", "copyright <<any:1-8>> all rights reserved"),
)
TEMPLATES = TEXTS + NOTICES

# Bytes that are part of a word: digits, letters (A-Z lower-cased) and all of other characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


class Automaton:
    """States are numbers; ``words[s]`` leads on by a word, ``free[s]`` by any, ``skips[s]`` without one."""

    def __init__(self, markup: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.free: list[bool] = [False]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        parts = [p for part in re.findall(r"<<[^>]*>>|[^<]+", markup) for p in ([part] if part[0] == "<" else words_of(part))]
        for part in parts:
            end = len(self.words) - 1
            if part == "<<optional>>":
                opened.append(end)
            elif part == "<</optional>>":
                if not opened:
                    raise ValueError(f"<</optional>> without <<optional>>: {markup}")
                self.skips[opened.pop()].append(end)
            elif isinstance(part, str) and (m := re.fullmatch(r"<<any:(\d+)-(\d+)>>", part)):
                low, high = map(int, m.groups())
                steps = [end]
                for _ in range(high):
                    self.free[steps[-1]] = True
                    steps.append(self._state())
                for s in steps[low:-1]:
                    self.skips[s].append(steps[-1])
            elif isinstance(part, str):
                raise ValueError(f"unknown markup {part}")
            else:
                self.words[end][part] = self._state()
        self.end = len(self.words) - 1
        if opened:
            raise ValueError(f"<<optional>> is not closed: {markup}")
        begin = self._closed({0})
        #: Words that an accepted stretch can begin with; None if any word can begin it.
        self.first = None if any(self.free[s] for s in begin) else {w for s in begin for w in self.words[s]}

    def _state(self) -> int:
        self.words.append({})
        self.free.append(False)
        self.skips.append([])
        return len(self.words) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def length_at(self, words: list[bytes], at: int) -> int:
        """Words of the longest accepted stretch that begins at a place; 0 if none is."""
        states, best, i = self._closed({0}), 0, at
        while states and i < len(words):
            word, after = words[i], set()
            for s in states:
                if (t := self.words[s].get(word)) is not None:
                    after.add(t)
                if self.free[s]:
                    after.add(s + 1)
            states = self._closed(after)
            i += 1
            if self.end in states:
                best = i - at
        return best


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(markup)) for label, markup in templates]


def phrase_places(words: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand consecutively; joined: a space before and after each word."""
    out, at = [], joined.find(phrase)
    before, counted = 0, 0
    while at >= 0:
        before += joined.count(b" ", counted, at)
        counted = at
        out.append(before)
        at = joined.find(phrase, at + 1)
    return out


def template_matches(words: list[bytes], automata: list[tuple[str, Automaton]]) -> list[tuple[str, int, int]]:
    """(label, start, length) of each accepted stretch; of those that overlap under one label the first."""
    present = set(words)
    out = []
    for label, automaton in automata:
        first = present if automaton.first is None else automaton.first & present
        if not first:
            continue
        free_until = 0
        places = _places(words, next(iter(first))) if len(first) == 1 else [i for i, w in enumerate(words) if w in first]
        for at in places:
            if at >= free_until and (n := automaton.length_at(words, at)):
                out.append((label, at, n))
                free_until = at + n
    return out


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs, from its whole text:

    doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (of these places; null without any), base_labels and labels (sorted, distinct,
    comma-joined), matches (label:word:length of accepted templates), and score:
    1 if a whole license text is accepted, 0.75 with a notice, 0.5 with base
    phrases only, else 0. A null text
    counts as empty: no words, empty labels. Repeated rows get equal values.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = compiled(templates)
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                base = [(at, label) for p, label in phrases for at in phrase_places(words, joined, p)]
                found = template_matches(words, automata)
                places, names = [at for at, _ in base], {label for _, label in base}
                out.append(
                    (
                        len(words), len(base), min(places, default=None), max(places, default=None),
                        ",".join(sorted(names)), ",".join(sorted(names | {label for label, _, _ in found})),
                        ",".join(f"{label}:{at}:{n}" for label, at, n in sorted(found, key=lambda m: (m[1], m[0]))),
                        max([0.75 if label.endswith("-notice") else 1.0 for label, _, _ in found], default=0.5 if base else 0.0),
                    )
                )
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    made = by_row(rows, run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, matches string, score double")
    return rows.select("doc_id", made("text").alias("made")).select("doc_id", "made.*")
