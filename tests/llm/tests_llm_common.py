"""Plain versions of what several tests need."""

import re

SMALL = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")
