import re


import pytest


@pytest.fixture()
def documents(spark):
    def make(rows, extra=False):
        if extra:
            schema = "doc_id long, text string, lang string, h1 long, packed string, low string, digest string"
            return spark.createDataFrame([(*r, None, 1, "x", "y", "z") if len(r) == 2 else (*r, 1, "x", "y", "z") for r in rows], schema)
        return spark.createDataFrame([(*r, None)[:3] for r in rows], "doc_id long, text string, lang string")
    return make


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "é" * 50), (None, "no id " * 20)]
