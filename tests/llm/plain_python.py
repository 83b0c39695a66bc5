"""Odd rows, and plain Python versions of the definitions that tests share."""

import hashlib
import re

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
PASSAGE = " ".join(f"Word{i}" for i in range(60))
ODD = [
    (1, SENTENCE),
    (2, SENTENCE),
    (3, SENTENCE + " phi"),
    (4, "before " + PASSAGE + " after"),
    (5, "other start\n" + PASSAGE + "\tother end"),
    (6, None),
    (7, ""),
    (8, " \n\t "),
    (9, "one two"),
    (10, "é" * 150 + " " + SENTENCE.upper()),
    (11, ("tick tock " * 400).strip()),
    (12, "MIT License. Released under the Apache License, Version 2.0; see the General Public License"),
    (12, "a repeated key"),
    (13, SENTENCE),
    (13, SENTENCE),
    (None, SENTENCE),
    (None, None),
    (14, "x" * 700),
]


#: Two different words that have one polynomial hash modulo 2**64, whatever its base.
TWINS = ["".join("ab"[(i.bit_count() + first) & 1] for i in range(1024)) for first in (0, 1)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def blank_separated(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def same(found, expected):
    """Equal as bags of rows."""
    key = lambda row: [(v is not None, str(v)) for v in row]
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)
