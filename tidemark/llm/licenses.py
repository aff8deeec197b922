"""Licence scan by sentence rules: sentences become identifiers, ordered rules match identifier sequences.

A text is cut into sentences, each is normalised (lower case, punctuation to spaces, version numbers to ``<v>``) and
looked up among known licence sentences. A sentence may be wrapped over lines: a line that begins one takes the next
lines as long as they go on with a known sentence, and the longest one counts. Known sentences of at least ``LONG``
words are also found where the text is not cut as they are, behind a title or a copyright line, after a colon, or with
all on one line: word by word, whatever stands between the words. The identifiers found, in text order, are then read
from left to right; at each place the first rule in the list whose sequence matches wins and consumes it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Normalised licence sentences by identifier. Several wordings may share one.
SENTENCES: dict[str, tuple[str, ...]] = {
    "ApacheRef": ("licensed under the apache license version <v>", "this file is licensed under the apache license version <v>", "released under the apache license version <v>"),
    "ApacheComply": ("you may not use this file except in compliance with the license",),
    "ApacheCopy": ("you may obtain a copy of the license at http www apache org licenses license <v>",),
    "GplRef": ("this work is licensed under the gnu general public license version <v>", "licensed under the gnu general public license version <v>", "this program is licensed under the gnu general public license version <v>"),
    "GplLater": ("licensed under the gnu general public license version <v> or later", "this work is licensed under the gnu general public license version <v> or any later version"),
    "LgplRef": ("licensed under the gnu lesser general public license version <v>", "this work is licensed under the gnu lesser general public license version <v>"),
    "MitRef": ("released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"),
    "MitGrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "AsIs": ("the software is provided as is without warranty of any kind express or implied",),
    "BsdGrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BsdEndorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "MplRef": ("this source code form is subject to the terms of the mozilla public license v <v>", "licensed under the mozilla public license version <v>"),
    "CcBy": ("licensed under cc by <v>", "this work is licensed under cc by <v>"),
    "CcBySa": ("licensed under cc by sa <v>", "this work is licensed under cc by sa <v>"),
    "CcByNc": ("licensed under cc by nc <v>", "this work is licensed under cc by nc <v>"),
    "CcByNd": ("licensed under cc by nd <v>", "this work is licensed under cc by nd <v>"),
    "CcByNcSa": ("licensed under cc by nc sa <v>", "this work is licensed under cc by nc sa <v>"),
    "CcZero": ("this work is dedicated to the public domain", "released under cc <v> zero"),
    "AllRights": ("all rights reserved",),
}
#: Licences in order of precedence, each with its sequence of identifiers; ``<v>`` is the first version.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-<v>", ("ApacheRef", "ApacheComply", "ApacheCopy")),
    ("Apache-<v>", ("ApacheRef",)),
    ("GPL-<v>-or-later", ("GplLater",)),
    ("GPL-<v>", ("GplRef",)),
    ("LGPL-<v>", ("LgplRef",)),
    ("MIT", ("MitRef",)),
    ("MPL-<v>", ("MplRef",)),
    ("CC-BY-NC-SA-<v>", ("CcByNcSa",)),
    ("CC-BY-NC-<v>", ("CcByNc",)),
    ("CC-BY-ND-<v>", ("CcByNd",)),
    ("CC-BY-SA-<v>", ("CcBySa",)),
    ("CC-BY-<v>", ("CcBy",)),
    ("CC0", ("CcZero",)),
    ("Proprietary", ("AllRights",)),
)

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_TERMS = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_HEADS = ("", "this program is free software ", "this library is free software ", "this file is free software ", "this is free software ")
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"


def _gnu(kind: str, tail: str = "") -> tuple[str, ...]:
    return tuple(head + _TERMS.format(kind) + tail for head in _HEADS)


def _gnu_only(kind: str) -> tuple[str, ...]:
    return (*_gnu(f"{kind} version <v>"), *_gnu(kind, " version <v>"), *_gnu(kind, " version <v> of the license"), *_gnu(kind, " either version <v> of the license"))


#: Names of the Creative Commons licences and of their deeds' terms.
_CC = (("CcBy", "attribution"), ("CcBySa", "attribution sharealike"), ("CcByNc", "attribution noncommercial"), ("CcByNd", "attribution noderivatives"), ("CcByNcSa", "attribution noncommercial sharealike"), ("CcByNcNd", "attribution noncommercial noderivatives"))
#: SPDX identifiers as normalised, and the licences as named here.
_SPDX = (
    ("mit", "MIT"), ("isc", "ISC"), ("apache <v>", "Apache-<v>"), ("bsd <v> clause", "BSD-<v>-Clause"), ("gpl <v> only", "GPL-<v>"), ("gpl <v>", "GPL-<v>"), ("gpl <v> or later", "GPL-<v>-or-later"), ("lgpl <v> only", "LGPL-<v>"), ("lgpl <v>", "LGPL-<v>"),
    ("lgpl <v> or later", "LGPL-<v>-or-later"), ("agpl <v> only", "AGPL-<v>"), ("agpl <v>", "AGPL-<v>"), ("agpl <v> or later", "AGPL-<v>-or-later"), ("mpl <v>", "MPL-<v>"), ("epl <v>", "EPL-<v>"), ("bsl <v>", "BSL-<v>"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("cc <v> <v>", "CC0"),
    ("cc by <v>", "CC-BY-<v>"), ("cc by sa <v>", "CC-BY-SA-<v>"), ("cc by nc <v>", "CC-BY-NC-<v>"), ("cc by nd <v>", "CC-BY-ND-<v>"), ("cc by nc sa <v>", "CC-BY-NC-SA-<v>"), ("cc by nc nd <v>", "CC-BY-NC-ND-<v>"), ("mit or apache <v>", "MIT OR Apache-<v>"), ("apache <v> or mit", "MIT OR Apache-<v>"),
)


def _deeds(name: str) -> tuple[str, ...]:
    return tuple(f"{what}licensed under {the} creative commons {name} <v> {where}license" for what in ("", "this work is ", "this content is ", "this document is ") for the in ("a", "the") for where in ("", "international ", "unported "))


_LATER = "either version <v> of the license or at your option any later version"
#: Sentences of the licences as published, which the SQL form does not have. A semicolon ends a sentence.
STANDARD: dict[str, tuple[str, ...]] = {
    "ApacheRef": ("licensed under the apache license version <v> the license", "the asf licenses this file to you under the apache license version <v> the license"),
    "ApacheCopy": ("you may obtain a copy of the license at https www apache org licenses license <v>",),
    "MitGrant": (_MIT,),
    "MitNotice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "AsIs": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "BsdEndorse": (
        f"neither the name of the author nor the names of its contributors {_ENDORSE}", f"neither the name of the university nor the names of its contributors {_ENDORSE}", f"neither the name of the organization nor the names of its contributors {_ENDORSE}",
        f"neither the name of the copyright holders nor the names of its contributors {_ENDORSE}", f"neither the names of the copyright holders nor the names of the contributors {_ENDORSE}", f"the name of the author may not {_ENDORSE[4:]}",
    ),
    "GplTerms": _gnu("general public license"),
    "LgplTerms": (*_gnu("lesser general public license"), *_gnu("library general public license")),
    "LaterVersion": (_LATER,),
    "GplRef": _gnu_only("general public license"),
    "GplLater": _gnu("general public license", f" {_LATER}"),
    "LgplRef": _gnu_only("lesser general public license"),
    "LgplLater": _gnu("lesser general public license", f" {_LATER}"),
    "GplTitle": ("gnu general public license version <v> <v> june <v>", "gnu general public license version <v> june <v>"),
    "AgplRef": _gnu_only("affero general public license"),
    "AgplLater": _gnu("affero general public license", f" {_LATER}"),
    "AgplTitle": ("gnu affero general public license version <v> <v> november <v>",),
    "ApacheTitle": ("apache license version <v> january <v>",),
    "MplTitle": ("mozilla public license version <v>",),
    "EplRef": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license <v> which is available at https www eclipse org legal epl <v>",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v <v> which accompanies this distribution and is available at http www eclipse org legal epl v <v> html",
    ),
    "IscGrant": tuple(f"permission to use copy modify {both} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for both in ("and or", "and")),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "ZlibGrant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "BoostRef": ("distributed under the boost software license version <v>", "boost software license version <v> august <v> th <v>"),
    "BoostGrant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "BsdAdvert": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "CcZero": ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",),
    **{name: _deeds(terms) for name, terms in _CC},
    **{f"Spdx{k}": (f"spdx license identifier {key}",) for k, (key, _) in enumerate(_SPDX)},
    "LgplTitle": ("gnu lesser general public license version <v> <v> june <v>", "gnu lesser general public license version <v> february <v>"),
}
KNOWN: dict[str, tuple[str, ...]] = {name: SENTENCES.get(name, ()) + STANDARD.get(name, ()) for name in SENTENCES | STANDARD}
_BSD = ("BsdGrant", "BsdSource", "BsdBinary")
#: A copyright line's "all rights reserved" before a licence is part of it; longer sequences come before shorter ones.
ALL_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    *((name, (*head, *sequence)) for name, sequence in (("BSD-4-Clause", (*_BSD, "BsdAdvert", "BsdEndorse")), ("BSD-3-Clause", (*_BSD, "BsdEndorse")), ("BSD-2-Clause", _BSD)) for head in ((), ("AllRights",))),
    ("ISC", ("AllRights", "IscGrant")),
    ("EPL-<v>", ("AllRights", "EplRef")),
    ("BSL-<v>", ("BoostRef", "BoostGrant")),
    *RULES,
    ("ISC", ("IscGrant",)),
    ("GPL-<v>-or-later", ("GplTerms", "LaterVersion")),
    ("LGPL-<v>-or-later", ("LgplTerms", "LaterVersion")),
    ("LGPL-<v>-or-later", ("LgplLater",)),
    ("AGPL-<v>-or-later", ("AgplLater",)),
    ("AGPL-<v>", ("AgplRef",)),
    ("GPL-<v>", ("GplTitle",)),
    ("LGPL-<v>", ("LgplTitle",)),
    ("AGPL-<v>", ("AgplTitle",)),
    ("Apache-<v>", ("ApacheTitle",)),
    ("MPL-<v>", ("MplTitle",)),
    ("EPL-<v>", ("EplRef",)),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-<v>", ("BoostRef",)),
    ("BSL-1.0", ("BoostGrant",)),  # the only version with this grant
    ("CC-BY-NC-ND-<v>", ("CcByNcNd",)),
    *((name, (f"Spdx{k}",)) for k, (_, name) in enumerate(_SPDX)),
)

SPLIT = re.compile(r"((?:(?<!\bv)(?<!\bV)\.|[!?;])[ \t\n\x0b\x0c\r]+|\n)")
VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PUNCTUATION = re.compile(r"[\x00-\x2f\x3a-\x3b\x3d\x3f-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Words of a normalised text; a sentence of at least ``LONG`` of them is looked for at any word.
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z\x80-\U0010ffff]+")
LONG = 10
OUT = pa.schema([("row_id", pa.int64()), ("sentence_ids", pa.list_(pa.string())), ("licences", pa.list_(pa.string()))])


def normalised(sentence: str) -> tuple[str, str]:
    """The sentence as looked up, and its first version number."""
    low = sentence.translate(LOWER).replace("<", " ").replace(">", " ")
    found = VERSION.search(low)
    return PUNCTUATION.sub(" ", VERSION.sub(" <v> ", low)).replace("  ", " ").replace("  ", " ").strip(" "), found[0] if found else ""


class Scanner:
    def __init__(self, sentences: dict[str, tuple[str, ...]], rules: tuple[tuple[str, tuple[str, ...]], ...]):
        self.known = {text: name for name, texts in sentences.items() for text in texts}
        words = [x.split() for x in self.known]
        self.begun = {" ".join(w[:n]) for w in words for n in range(1, len(w) + 1)}
        starts = sorted({x.split()[0] for x in self.known})
        self.start = re.compile(rf"[^0-9a-z\x80-\U0010ffff]*(?:{'|'.join(map(re.escape, starts))})(?:[\x00-\x60\x7b-\x7f]|\Z)", re.I | re.A)
        self.rules = rules
        self.long: dict[tuple[str, ...], list[list[str]]] = {}
        for w in sorted((w for w in words if len(w) >= LONG), key=len, reverse=True):
            self.long.setdefault(tuple(w[:3]), []).append(w)
        # every long sentence has one of these words, and few texts have any
        self.marks = sorted({max(w, key=len) for w in words if len(w) >= LONG})
        between = r"[^0-9a-z\x80-\U0010ffff]+"
        self.heads = re.compile("|".join(between.join(map(re.escape, x)) for x in sorted(self.long)), re.I | re.A) if self.long else re.compile(r"(?!)")

    def sentences(self, text: str) -> list[tuple[int, int, str, str]]:
        """(begin, end, identifier, version) of the known sentences that the text is cut into."""
        out = []
        parts = SPLIT.split(text)  # sentences or lines, and between them what ended them
        places = list(itertools.accumulate(map(len, parts), initial=0))
        at = 0
        while at < len(parts):
            end = at
            if self.start.match(parts[at]):
                sentence, last, found = parts[at], at, None
                while True:
                    key, version = normalised(sentence)
                    if key in self.known:
                        found, end = (places[at], places[last + 1], self.known[key], version), last
                    if key not in self.begun or last + 2 >= len(parts) or parts[last + 1] != "\n":
                        break
                    last += 2
                    sentence += "\n" + parts[last]
                if found:
                    out.append(found)
            at = end + 2
        return out

    def long_ones(self, text: str) -> list[tuple[int, int, str, str]]:
        """The same of the long sentences wherever they stand, the longest at each place."""
        low = text.lower()
        if not any(x in low for x in self.marks):
            return []
        starts = [m.start() for m in self.heads.finditer(text)]
        tokens = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text.translate(LOWER))]
        words = ["<v>" if w[0] in "0123456789" else w for _, _, w in tokens]
        at_place = {begin: k for k, (begin, _, _) in enumerate(tokens)}
        out, done = [], 0
        for begin in starts:
            k = at_place.get(begin)
            if k is None or k < done:
                continue
            for sentence in self.long.get(tuple(words[k : k + 3]), ()):
                if words[k : k + len(sentence)] == sentence:
                    done = k + len(sentence)
                    version = next((w for _, _, w in tokens[k:done] if w[0] in "0123456789"), "")
                    out.append((begin, tokens[done - 1][1], self.known[" ".join(sentence)], version))
                    break
        return out

    def identify(self, text: str | None) -> list[tuple[str, str]]:
        """(identifier, version) of the known sentences, in text order."""
        long = self.long_ones(text or "")
        short = [x for x in self.sentences(text or "") if not any(x[0] < y[1] and y[0] < x[1] for y in long)] if long else self.sentences(text or "")
        return [x[2:] for x in sorted(long + short)]

    def licences(self, found: list[tuple[str, str]]) -> list[str]:
        """Licence of each matched sequence, in text order."""
        out, at, ids = [], 0, tuple(x for x, _ in found)
        while at < len(ids):
            for name, sequence in self.rules:
                if ids[at : at + len(sequence)] == sequence:
                    version = next((v for _, v in found[at : at + len(sequence)] if v), "")
                    out.append(name.replace("<v>", version))
                    at += len(sequence)
                    break
            else:
                at += 1
        return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict = KNOWN, rules: tuple = ALL_RULES) -> DataFrame:
    """(id, ``sentence_ids``, ``licences``) of every row, both in text order, repeats included.

    Null and empty texts and texts without licence sentences give two empty lists; a known sentence that starts no
    rule's sequence is skipped. Repeated rows are scanned each for itself, empty tables give no rows, other columns
    are ignored. Rows stay in their partition: no shuffle.
    """
    common.tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for batch in batches:
            found = [scanner.identify(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[k for k, _ in x] for x in found], OUT.types[1]), pa.array([scanner.licences(x) for x in found], OUT.types[2])], schema=OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.lean(run), "row_id long, sentence_ids array<string>, licences array<string>").withColumnRenamed("row_id", id_col)


def op1_licences(spark, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def sql() -> str:
    """The same scan in DuckDB SQL. Each identifier is a letter, a document its letters with versions, and the
    ordered rules one alternation."""
    letter = {name: chr(65 + k) for k, name in enumerate(SENTENCES)}
    known = _values([(text, letter[name], name) for name, texts in SENTENCES.items() for text in texts])
    keys = ["".join(letter[x] for x in sequence) for _, sequence in RULES]
    alternation = "|".join("".join(f"{c}[0-9.]*;" for c in key) for key in keys)
    names = _values([(key, name) for key, (name, _) in zip(keys, RULES)])
    return rf"""
WITH known(norm, letter, name) AS (VALUES {known}), rules(key, licence) AS (VALUES {names}),
parts AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '[.!?;][ \t\n\x0b\x0c\r]+', chr(10), 'g'), chr(10)),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ<>', 'abcdefghijklmnopqrstuvwxyz  ')) AS s
  FROM documents
), sentences AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM parts
), normed AS (
  SELECT doc_id, pos, regexp_extract(s, '[0-9]+(\.[0-9]+)*') AS version,
    trim(regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+(\.[0-9]+)*', ' <v> ', 'g'), '[\x00-\x2f\x3a-\x3b\x3d\x3f-\x60\x7b-\x7f]+', ' ', 'g'), ' +', ' ', 'g')) AS norm
  FROM sentences
), found AS (
  SELECT n.doc_id, count(*) AS n_sentences, string_agg(k.name, ',' ORDER BY n.pos) AS sentence_ids,
         string_agg(k.letter || n.version || ';', '' ORDER BY n.pos) AS code
  FROM normed n JOIN known k ON n.norm = k.norm GROUP BY n.doc_id
), hits AS (
  SELECT doc_id, unnest(m) AS m, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(code, '{alternation}') AS m FROM found)
), named AS (
  SELECT h.doc_id, string_agg(replace(r.licence, '<v>', regexp_extract(h.m, '[0-9.]+')), ',' ORDER BY h.pos) AS licences
  FROM hits h JOIN rules r ON regexp_replace(h.m, '[0-9.;]', '', 'g') = r.key GROUP BY h.doc_id
)
SELECT d.doc_id, coalesce(f.n_sentences, 0) AS n_sentences, coalesce(f.sentence_ids, '') AS sentence_ids, coalesce(n.licences, '') AS licences
FROM documents d LEFT JOIN found f USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


OP1_SQL = sql()
