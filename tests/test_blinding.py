import re

import pytest
from pyspark.sql import functions as F

from threadweave.functions import scalars as S
from threadweave.operators import judging, leakage, reports
from threadweave.plans import panels

TEXTS = [
    None, "", "  ", "Use a list.", "According to the retrieved sources, use a list. the provided context does not specifically address it,  so try.", "In the context of threads, use a lock.",
    "Unfortunately, the context provided doesn't cover this .", "there are no clear details in the given documents about it", "It isn't directly covered in the sources. as noted in the search results, fine.", "works, based on the sources.\nthe retrieved context provides: a way",
    "more may be needed beyond the context provided", "The sources suggest that é works [SO-12]. Sources of error abound.", "See [SO 5] and  [SO: thread 7].\n\nSources:\n1. x\n2. y", "THE RETRIEVED SOURCES EXPLICITLY CONFIRM THAT it works. é starts. b starts",
    "from the supplied information, x. y", "The code snippet you provided is fine.", "per your given materials: a. in the sources of x", "the sources\ndo not mention it!\n\nnext line. and so on",
]


def plainly(text):
    out = re.sub(r"\n+\s*\**\s*(sources|references)\s*:?\s*\**\s*:?\s*\n.*$", "", text or "", flags=re.I | re.S)
    out = re.sub(r"[ \t]{2,}", " ", re.sub(r"(?i)\[SO(?=[-:\s<\]])[^\]]{0,20}\]", "", out)).strip()
    bare, hits = out, []
    for name, pattern, instead in S.PHRASES:
        hits += [(name, m.group(0)) for m in re.finditer(pattern, out, re.I)]
        out = re.sub(pattern, instead.replace("$", "\\"), out, flags=re.I)
    if not hits:
        return bare, hits
    out = re.sub(r"[ \t]+([,.;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", out))
    out = re.sub(r",([.;:!?])", r"\1", out)
    return re.sub(r"(^|[.!?]\s+|\n)([a-z])", lambda m: m.group(1) + m.group(2).upper(), out).strip(), hits


def test_blinding(spark):
    texts = TEXTS + [r + (t or "") for r in panels.REMARKS for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = df.select("k", S.blinded_fully(F.col("t")).alias("out"), S.phrases_replaced(S.blinded(F.col("t")))[1].alias("hits")).collect()
    for r in got:
        assert (r.out, [tuple(h) for h in r.hits]) == plainly(texts[r.k]), texts[r.k]
    assert {h.name for r in got for h in r.hits} == {p[0] for p in S.PHRASES}


def test_each_pattern_is_looked_for_once(spark):
    """Not once for every later pattern, nor for every word of the text."""
    df = spark.createDataFrame([("In the sources, " + "some words. " * 5000 + "end",)], "t string").select(S.blinded_with_hits(F.col("t")).alias("x"), S.blinded_fully(F.col("t")).alias("y"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") <= 2 * len(S.PHRASES) and plan.count("split(") <= 2
    got = df.select("x.*", "y").first()
    assert got.text == got.y == "Some words. " * 5000 + "End" and [h.name for h in got.hits] == ["attribution_prefix"]


def test_unknown_labels_fail(spark):
    votes = spark.createDataFrame([(1, "a", "FAKTUAL"), (1, "b", "odd"), (1, "c", None)], "item long, judge string, label string")
    for f in (judging.panel_labels, lambda v: reports.even_panel_labels(v, True)):
        with pytest.raises(Exception, match="unknown label: odd"):
            f(votes).collect()
        assert f(votes.where("label IS NULL OR label <> 'odd'")).count() == 1


def test_substrings_met_in_a_join(spark):
    """Beyond the hashes that are sent, the same pairs."""
    line = "a line that very many of the texts have in common, whatever else they say"
    texts = spark.createDataFrame([(k, f"{k} begins. {line if k % 2 else ''} {k * 7919} ends here and has enough of its own to say {k}") for k in range(20)] + [(99, None)], "k long, text string")
    items = spark.createDataFrame([(k, f"item {k} {line[:60]}") for k in range(5)] + [(7, texts.where("k = 4").first().text), (8, "")], "i long, text string")
    pairs = lambda **k: sorted(map(tuple, leakage.shared_substrings(texts, "k", items, "i", **k).collect()))
    assert pairs() == pairs(sent=3) and len(pairs()) > 50
