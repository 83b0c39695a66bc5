"""License notices in texts: ordered signature rules behind a keyword gate.

A text becomes its lower-case words, one blank apart. Texts without a gate word are done at once. In the others
every rule whose own words are there is searched; detections are taken by rank (kind of rule, then length,
then place), and one that lies inside an accepted detection is dropped. Plain phrases (``BASE``) are found on
their own and always count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tableflow.llm.batches import TO_WORDS, extend, utf8

BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: label, name as a pattern over words, a word that every match holds, identifiers, words of its address.
FAMILIES = [
    ("mit", r"(?:mit|expat|x11)", "", ["mit", "mit 0", "x11"], r"opensource org licenses? mit"),
    ("apache", r"(?:the )?apache(?: software)?", "apache", ["apache 1 1", "apache 2 0"], r"apache org licenses? license 2 0"),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", "", ["gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 3 0 or later"], r"gnu org licenses? gpl(?: [123] 0)?"),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "", ["lgpl 2 1", "lgpl 3 0"], r"gnu org licenses? lgpl(?: [23] [01])?"),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", "", ["agpl 3 0"], r"gnu org licenses? agpl(?: 3 0)?"),
    ("fdl", r"(?:gnu )?(?:free documentation|gfdl)", "", ["gfdl 1 2", "gfdl 1 3"], r"gnu org licenses? fdl(?: 1 [23])?"),
    ("bsd", r"(?:(?:new|modified|simplified|revised) )?(?:[234] clause )?bsd(?: [234] clause)?", "bsd", ["bsd 2 clause", "bsd 3 clause", "0bsd"], r"opensource org licenses? bsd(?: [23] clause)?"),
    ("isc", r"isc", "isc", ["isc"], r"opensource org licenses? isc"),
    ("mpl", r"(?:mozilla public|mpl)", "", ["mpl 1 1", "mpl 2 0"], r"mozilla org (?:en us )?mpl(?: [12] [01])?"),
    ("epl", r"(?:eclipse public|epl)", "", ["epl 1 0", "epl 2 0"], r"eclipse org legal epl(?: v?[12]0)?"),
    ("cddl", r"(?:common development and distribution|cddl)", "", ["cddl 1 0", "cddl 1 1"], r"opensource org licenses? cddl1?"),
    ("eupl", r"(?:european union public|eupl)", "", ["eupl 1 1", "eupl 1 2"], r"eupl eu 1 [12]"),
    ("artistic", r"(?:the )?artistic", "artistic", ["artistic 1 0", "artistic 2 0"], r"perlfoundation org artistic license 2 0"),
    ("boost", r"boost software", "boost", ["bsl 1 0"], r"boost org license 1 0 txt"),
    ("zlib", r"zlib(?: libpng)?", "zlib", ["zlib"], r"zlib net zlib license html"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", ["unlicense"], r"unlicense org"),
    ("cc0", r"(?:cc0|creative commons zero)", "", ["cc0 1 0"], r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "", ["cc by 3 0", "cc by 4 0"], r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "", ["cc by sa 3 0", "cc by sa 4 0"], r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "", ["cc by nc 3 0", "cc by nc 4 0"], r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", "", ["cc by nd 4 0"], r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "", ["cc by nc sa 4 0"], r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("psf", r"(?:python software foundation|psf)", "", ["psf 2 0", "python 2 0"], r"docs python org 3 license html"),
    ("postgresql", r"postgresql", "postgresql", ["postgresql"], r"postgresql org about licen[cs]e"),
    ("php", r"php", "php", ["php 3 0", "php 3 01"], r"php net license 3 01 txt"),
    ("ruby", r"ruby", "ruby", ["ruby"], r"ruby lang org en about license txt"),
    ("openssl", r"openssl", "openssl", ["openssl"], r"openssl org source license html"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", ["ncsa"], r"opensource org licenses? ncsa"),
    ("wtfpl", r"(?:wtfpl|do what the f\w+ you want to public)", "", ["wtfpl"], r"wtfpl net"),
    ("ofl", r"(?:sil )?open font", "font", ["ofl 1 1"], r"scripts sil org ofl"),
    ("ms-pl", r"microsoft public", "microsoft", ["ms pl"], r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal", "microsoft", ["ms rl"], r"opensource org licenses? ms rl"),
    ("upl", r"universal permissive", "universal", ["upl 1 0"], r"oss oracle com licenses upl"),
    ("odbl", r"open (?:data commons open )?database", "database", ["odbl 1 0"], r"opendatacommons org licenses odbl"),
    ("osl", r"open software", "software", ["osl 3 0"], r"opensource org licenses? osl 3 0"),
    ("afl", r"academic free", "academic", ["afl 3 0"], r"opensource org licenses? afl 3 0"),
]

#: kind: rank (higher first) and confidence.
KINDS = {"identifier": (6, 1.0), "text": (5, 0.95), "grant": (4, 0.9), "address": (3, 0.85), "version": (2, 0.8), "name": (1, 0.6)}
BASE_CONFIDENCE = 0.5

#: Sentences that stand in one family's license text only.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("wtfpl", "you just do what the f"),
]

#: Gate words of the rules whose matches all hold one; other rules are gates by their own words.
ROOTS = ("licen", "permission", "redistribut", "copyright", "software", "creativecommons")


@dataclass(frozen=True)
class Rule:
    kind: str
    label: str
    word: bytes  # stands in every match
    gate: bytes  # so does this
    pattern: re.Pattern


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules, from the forms in which a family is named: about 300."""
    out = []

    def add(kind, label, word, pattern, own=""):
        always, inner = pattern, None
        while always != inner:  # without choices and optional parts
            inner, always = always, re.sub(r"\(\?:[^()]*\)\??", "|", always)
        gate = next((root for root in ROOTS if root in always), own or word)
        out.append(Rule(kind, label, word.encode(), gate.encode(), re.compile(rf"(?<= )(?:{pattern})(?= )".encode())))

    for label, sentence in SENTENCES:
        add("text", label, sentence.split()[-1], re.escape(sentence).replace(r"\ ", " ") + r"\w*", sentence)
    for label, name, word, identifiers, address in FAMILIES:
        for identifier in identifiers:
            add("identifier", label, "spdx", rf"spdx licen[cs]e identifier {identifier}")
        called = rf"{name} licen[cs]e" if label != "unlicense" else name
        add("grant", label, word or "under", rf"licen[cs]ed (?:\w+ )?under (?:the )?(?:terms of )?(?:the )?(?:{called}|{name})")
        add("grant", label, word or "under", rf"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{called}")
        add("grant", label, word or "subject", rf"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{called}")
        add("address", label, address.split()[0].split("(")[0], rf"(?:https? )?(?:www )?{address}")
        add("version", label, word or "licen", rf"{called} (?:version |v ?)\d(?: \d)?")
        add("name", label, word or "licen", called)
    return out


@lru_cache(1)
def gates() -> list[bytes]:
    """Words and phrases of which every match of a rule or base phrase holds one."""
    return sorted({rule.gate for rule in rules()} | {b"licen"})


def detect(text: bytes) -> list[tuple[int, int, Rule]]:
    """Accepted detections in blank-framed words: start and end byte, rule."""
    found = []
    for order, rule in enumerate(rules()):
        if rule.word in text:
            rank = KINDS[rule.kind][0]
            found += [(-rank, m.start() - m.end(), m.start(), order, m.end(), rule) for m in rule.pattern.finditer(text)]
    accepted: list[tuple[int, int, Rule]] = []
    for _, _, start, _, end, rule in sorted(found, key=lambda x: x[:4]):
        if not any(a <= start and end <= b for a, b, _ in accepted):
            accepted.append((start, end, rule))
    return accepted


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase starts."""
    out, at, words, counted = [], text.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += text.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = text.find(b" " + phrase + b" ", at + 1)
    return out


def scan(raw: bytes) -> tuple[int, list[int], set[str], set[str], float]:
    """Number of words, starts of base phrases, base labels, all labels, score."""
    words = raw.translate(TO_WORDS).split()
    count = len(words)
    text = b" " + b" ".join(words) + b" "
    if not any(gate in text for gate in gates()):
        return count, [], set(), set(), 0.0
    starts, base = [], set()
    for phrase, label in BASE.items():
        if places := _places(text, phrase):
            starts += places
            base.add(label)
    accepted = detect(text)
    score = max([BASE_CONFIDENCE] * bool(starts) + [KINDS[rule.kind][1] for _, _, rule in accepted], default=0.0)
    return count, starts, base, base | {rule.label for _, _, rule in accepted}, score


FIELDS = StructType(
    [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType())]
    + [StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType())]
)


def scan_licenses(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``FIELDS``; label lists are sorted and comma-joined, empty without a label.

    ``score`` is the confidence of the best detection, 0 without one. Null or empty text: no words, no labels.
    """

    def run(columns):
        buffer, offsets = utf8(columns[0])
        raw, ends = buffer.tobytes(), offsets.tolist()
        rows = [scan(raw[a:b]) for a, b in zip(ends, ends[1:])]
        join = lambda labels: ",".join(sorted(labels))
        return [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([min(r[1], default=None) for r in rows], pa.int64()),
            pa.array([max(r[1], default=None) for r in rows], pa.int64()),
            pa.array([join(r[2]) for r in rows], pa.string()),
            pa.array([join(r[3]) for r in rows], pa.string()),
            pa.array([r[4] for r in rows], pa.float64()),
        ]

    return extend(df, [F.col(text)], FIELDS, run, keep)
