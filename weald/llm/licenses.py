"""License scans by template-markup matching.

A template is a license's wording with markup: ``<<opt>> ... <</opt>>`` surrounds a region that may be left out, and
``<<var:a-b>>`` stands for a replaceable region of a to b arbitrary words (names, years, project titles). It is
compiled into a nondeterministic automaton over word tokens; a text is accepted where every mandatory word stands
exactly as in the template. The automaton is run bit-parallel (a Python integer is the set of live states).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm.common import map_slices

#: Phrases whose occurrences count as base matches, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates by label: the usual notices and the short licenses in full, as public license lists print them.
TEMPLATES = {
    "agpl-3.0": "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> gnu affero general public license <<opt>>as published by the free software foundation either<</opt>> version 3 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "artistic-2.0": "under the <<opt>>terms of the<</opt>> artistic license <<opt>>version<</opt>> 2 0",
    "bsl-1.0": "under the <<opt>>terms of the<</opt>> boost software license <<opt>>version<</opt>> 1 0 <<opt>>see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt<</opt>>",
    "cc0-1.0": "to the extent possible under law <<var:1-12>> has waived all copyright and related or neighboring rights to <<var:1-12>>",
    "cc-by-nc-nd-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nc nd 4 0 <<opt>>international<</opt>>",
    "cc-by-nc-sa-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nc sa 4 0 <<opt>>international<</opt>>",
    "cc-by-nd-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nd 4 0 <<opt>>international<</opt>>",
    "epl-2.0": "under the terms of the eclipse public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0 <<opt>>which <<opt>>accompanies this distribution and<</opt>> is available at <<var:1-8>><</opt>>",
    "zlib": "this software is provided <<var:2-2>> without any express or implied warranty in no event will the <<var:1-4>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<var:1-12>> <<var:2-2>> and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<</opt>> neither the name of <<var:1-12>> may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<var:1-12>> <<var:2-2>> and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "lgpl-2.1": "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> gnu lesser general public license <<opt>>as published by the free software foundation either<</opt>> version 2 1 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "lgpl-3.0": "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> gnu lesser general public license <<opt>>as published by the free software foundation either<</opt>> version 3 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 <<opt>>if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0<</opt>>",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-2.0": "licensed under the apache license <<opt>>version<</opt>> 2 0 <<opt>>the license you may not use this file except in compliance with the license <<opt>>you may obtain a copy of the license at http www apache org licenses license 2 0<</opt>><</opt>>",
    "cc-by-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by 4 0 <<opt>>international<</opt>>",
    "cc-by-nc-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nc 4 0 <<opt>>international<</opt>>",
    "cc-by-sa-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by sa 4 0 <<opt>>international<</opt>>",
    "gpl-2.0": "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 2 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "gpl-3.0": "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 3 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided <<var:2-2>> and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software the software is provided <<var:2-2>> without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "<<opt>>this <<var:1-6>> is<</opt>> released under the <<opt>>terms of the<</opt>> mit license",
}

_MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)-(\d+)>>|[^\s<>]+")


def parse(template: str) -> list:
    """The template as a tree: words are str, replaceable regions (least, most) tuples, optional regions lists."""
    stack: list[list] = [[]]
    for m in _MARK.finditer(template):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<</opt>>":
            inner = stack.pop()
            if not stack:
                raise ValueError(f"unbalanced markup: {template[:60]}")
            stack[-1].append(inner)
        elif m[1]:
            stack[-1].append((int(m[1]), int(m[2])))
        else:
            stack[-1].append(m[0])
    if len(stack) != 1:
        raise ValueError(f"unbalanced markup: {template[:60]}")
    return stack[0]


def mandatory(tree: list) -> list[str]:
    return [x for x in tree if isinstance(x, str)]


@dataclass
class Automaton:
    """State i is 'the next symbol is i'; state n accepts. skips[i]: the states reached from i without a word, i included."""

    symbols: list[bytes | None]  # None: any word
    skips: list[int]
    masks: dict[bytes, int]  # word -> the states that consume it
    anything: int
    starts: frozenset[bytes] | None  # the words a match may begin with; None: any
    needs: frozenset[bytes]  # words without which nothing is accepted

    @classmethod
    def of(cls, template: str) -> Automaton:
        tree = parse(template)
        symbols: list[bytes | None] = []
        jumps: list[tuple[int, int]] = []

        def lay(nodes: list) -> None:
            for x in nodes:
                begin = len(symbols)
                if isinstance(x, str):
                    symbols.append(x.encode())
                elif isinstance(x, tuple):
                    symbols.extend([None] * x[1])
                    jumps.extend((i, begin + x[1]) for i in range(begin + x[0], begin + x[1]))
                else:
                    lay(x)
                    jumps.append((begin, len(symbols)))

        lay(tree)
        skips = [1 << i for i in range(len(symbols) + 1)]
        for i in range(len(symbols), -1, -1):  # jumps lead forward only
            for a, b in jumps:
                if a == i:
                    skips[i] |= skips[b]
        masks: dict[bytes, int] = {}
        anything = 0
        for i, w in enumerate(symbols):
            if w is None:
                anything |= 1 << i
            else:
                masks[w] = masks.get(w, 0) | 1 << i
        first = {symbols[i] for i in range(len(symbols)) if skips[0] >> i & 1}
        if skips[0] >> len(symbols) & 1:
            raise ValueError("a template needs mandatory words")
        return cls(symbols, skips, masks, anything, None if None in first else frozenset(first), frozenset(x.encode() for x in mandatory(tree)))

    def longest(self, words: list[bytes], at: int) -> int | None:
        """End (exclusive) of the longest accepted run of words from `at`, or None."""
        live, end, accept = self.skips[0], None, 1 << len(self.symbols)
        for i in range(at, len(words)):
            step = live & (self.masks.get(words[i], 0) | self.anything)
            if not step:
                break
            live = 0
            while step:
                low = step & -step
                live |= self.skips[low.bit_length()]
                step ^= low
            if live & accept:
                end = i + 1
        return end

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost-longest matches that don't overlap."""
        out, at = [], 0
        while at < len(words):
            if (self.starts is None or words[at] in self.starts) and (end := self.longest(words, at)):
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


#: Bytes of a UTF-8 text to lower-case words: A-Z to a-z; all other ASCII but digits and a-z separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def phrase_starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase stands in b' w0 w1 ... '."""
    out, at = [], joined.find(phrase)
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(phrase, at + 1)
    return out


SPANS = "spans array<struct<label:string,kind:string,first:bigint,last:bigint>>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Every license span of every whole text: (id, n_words, spans), one row per input row, in a narrow map.

    A span is (label, kind 'base' or 'template', first word, last word), words from 0. Spans are in order of kind,
    label and place. Null and empty texts have no words and no spans; ids may be null or repeat; further columns are
    not read. Cost is linear in the text: automata run only where their mandatory words all occur.
    """
    automata = {k: Automaton.of(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    rarest = {k: b" " + max(a.needs, key=lambda w: (len(w), w)) + b" " for k, a in automata.items()}  # its longest word: looked for before anything is compared
    phrases = [(f" {k} ".encode(), v, len(k.split())) for k, v in (BASE if base is None else base).items()]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, spans = [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            joined = b" " + b" ".join(words) + b" "
            found = [{"label": label, "kind": "base", "first": at, "last": at + n - 1} for phrase, label, n in phrases for at in phrase_starts(joined, phrase)]
            likely = [k for k, w in rarest.items() if w in joined]
            have = set(words) if likely else ()
            for label in likely:
                if automata[label].needs <= have:
                    found += [{"label": label, "kind": "template", "first": a, "last": b - 1} for a, b in automata[label].matches(words)]
            counts.append(len(words))
            spans.append(sorted(found, key=lambda x: (x["kind"], x["label"], x["first"])))
        kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["id", "n_words", "spans"])

    id_type = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), scan, f"id {id_type}, n_words bigint, {SPANS}", text=1).withColumnRenamed("id", id_col)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan_licenses over all documents."""
    from weald.llm.common import table

    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] == "base")
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.when(F.exists("spans", lambda s: s["kind"] == "template"), 1.0).when(F.size("spans") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def template_regex(template: str) -> str:
    """The same language as a regular expression over ' w0 w1 ... ' (used by the SQL oracle only)."""

    def lay(nodes: list) -> str:
        return "".join(f"{re.escape(x)} " if isinstance(x, str) else f"(?:[^ ]+ ){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f"(?:{lay(x)})?" for x in nodes)

    return " " + lay(parse(template))


def op1_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    starts = []
    for phrase in BASE:
        words = phrase.split()
        starts.append("list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words)) + ")")
    base = ", ".join(f"CASE WHEN len({s}) > 0 THEN '{label}' END" for s, label in zip(starts, BASE.values(), strict=True))
    more = ", ".join(f"CASE WHEN regexp_matches(j, '{template_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda y: y IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, flatten([{', '.join(starts)}]) AS p, [{base}] AS b, [{more}] AS m FROM e)
SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
       {joined('b')} AS base_labels, {joined('list_concat(b, m)')} AS labels,
       CASE WHEN len(list_filter(m, lambda y: y IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM f"""
