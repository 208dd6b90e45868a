"""Judges' JSON against a plain reading of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadweave.operators import verdicts as V


def load(raw):
    for text in (raw, (re.search(r"\{.*\}", raw or "", re.S) or [""])[0]):
        try:
            return json.loads(text)
        except (ValueError, TypeError):
            pass
    return None


def judged(raw, strict):
    d = load(raw)
    if not isinstance(d, dict) or not isinstance(d.get("answer_attempted"), bool) or not isinstance(d.get("claims"), list):
        return None
    up = lambda x: str(x).strip().upper()
    if up(d.get("completeness", "")) not in V.COMPLETENESS or up(d.get("label", "")) not in V.LABELS:
        return None
    claims, notes = [], []
    for c in d["claims"]:
        if not isinstance(c, dict) or up(c.get("verdict", "")) not in V.VERDICTS:
            return None
        verdict, severity = up(c["verdict"]), c.get("severity")
        if isinstance(severity, str) and severity.strip().lower() in ("null", "none"):
            severity = None
            notes.append("severity")
        if severity is not None:
            severity = up(severity)
            if severity not in V.SEVERITIES:
                return None
        if strict and verdict not in V.ERRORS and severity:
            severity = None
            notes.append("severity_on_non_error")
        conflict = c.get("reference_conflict", False)
        if isinstance(conflict, str) and conflict.strip().lower() in ("true", "false"):
            conflict = conflict.strip().lower() == "true"
            notes.append("reference_conflict")
        if not isinstance(conflict, bool):
            return None
        claims.append((verdict, severity, conflict))
    errors = [c for c in claims if c[0] in V.ERRORS]
    label = V.ABSTAIN if not d["answer_attempted"] else V.FULLY if any(c[1] == "CORE" for c in errors) else V.PARTLY if errors else V.FACTUAL
    reported = up(d["label"])
    return d["answer_attempted"], up(d.get("completeness")), claims, reported, label, reported == label, not d["answer_attempted"] and bool(claims), notes, sum(c[1] is None for c in errors)


def supported(raw, context, offered):
    base, d = judged(raw, True), load(raw)
    if base is None:
        return None
    none = lambda x: None if x is None or str(x).strip().upper() in ("", "NULL", "NONE") else str(x).strip().upper()
    notes, approach, out = list(base[7]), none(d.get("approach_match")), []
    if base[0] and approach not in V.APPROACHES:
        return None
    if not base[0] and approach is not None:
        approach = None
        notes.append("approach_match_on_abstain")
    for c in d["claims"]:
        said, items, by = none(c.get("supported_by_context")), c.get("cited_items") or [], none(c.get("cited_item_supports"))
        if context and said not in ("YES", "NO") or not isinstance(items, list):
            return None
        if not context:
            notes += ["supported_by_context_without_context"] * (said != "N/A")
            said = "N/A"
        items = [str(k).strip().strip("[]").upper() for k in items]
        notes += ["cited_item_not_offered"] * sum(k not in offered for k in items)
        items = [k for k in items if k in offered]
        if items and by not in ("YES", "NO"):
            return None
        if not items and by is not None:
            by = None
            notes.append("cited_item_supports_without_citation")
        out.append((said, items, by))
    cited = [x for x in out if x[1]]
    faith = round(sum(x[0] == "YES" for x in out) / len(out), 4) if context and base[0] and out else None
    return notes, approach, out, faith, round(sum(x[2] == "YES" for x in cited) / len(cited), 4) if base[0] and cited else None


def texts(n, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    out = [None, "", "[]", "{", "no json", "3", '"x"', "null", 'say {"a": 1} done', '{"answer_attempted": true}']
    for _ in range(n):
        claims = []
        for _ in range(r.randint(0, 3)):
            c = {"verdict": pick("supported", " Contradicted ", "FABRICATED", "unverifiable", *(["odd", None, 3] if r.random() < 0.05 else []))}
            if r.random() < 0.8:
                c["severity"] = pick("core", "MINOR", None, "null", " None ", *(["grave", 2, True] if r.random() < 0.1 else []))
            if r.random() < 0.7:
                c["reference_conflict"] = pick(True, False, "true", " False", *([None, "yes", 0] if r.random() < 0.1 else []))
            if r.random() < 0.9:
                c["supported_by_context"] = pick("yes", "NO", "yes", *([None, "n/a", "null", 4] if r.random() < 0.2 else []))
            if r.random() < 0.7:
                c["cited_items"] = pick([], ["k1"], ["[K2]", "k9"], [" K1 ", 7, None], None, "", *(["K1", {"a": 1}, 5] if r.random() < 0.1 else []))
            if r.random() < 0.8:
                c["cited_item_supports"] = pick("YES", "no", None, *(["maybe"] if r.random() < 0.1 else []))
            claims.append(c)
        d = {"answer_attempted": pick(True, True, False), "completeness": pick("full", "Partial", "none", None), "label": pick(*V.LABELS, "faktual "), "claims": claims, "approach_match": pick("same", "DIFFERENT_VALID", None), "reasoning": "é\n{}"}
        if r.random() < 0.15:
            d[r.choice(list(d))] = pick(None, "x", 1, [1], {}, "true")
        if r.random() < 0.1:
            del d[r.choice(list(d))]
        text = json.dumps(d, ensure_ascii=r.random() < 0.5)
        out.append(pick(text, text, text, f"Here it is:\n```json\n{text}\n```", text + ",", text[:-1]))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_validated(spark, strict):
    rows = list(enumerate(texts(400, 3)))
    got = {r.id: r for r in V.validated(spark.createDataFrame(rows, "id long, raw string").repartition(3), "raw", strict).collect()}
    fine = 0
    for i, raw in rows:
        want, r = judged(raw, strict), got[i]
        assert r.parse_error == (want is None), raw
        mine = (r.answer_attempted, r.completeness, r.claims and [tuple(c) for c in r.claims], r.reported_label, r.label, r.consistent, r.conflict, r.normalized_fields, r.n_errors_without_severity)
        assert want is None and mine == (None,) * 9 or (mine[:2], list(mine[2] or []), mine[3:]) == (want[:2], want[2], want[3:]), raw
        fine += want is not None
    assert 100 < fine < 350


@pytest.mark.parametrize("context", [True, False])
def test_with_support(spark, context):
    rows = list(enumerate(texts(400, 4)))
    df = spark.createDataFrame(rows, "id long, raw string").withColumn("offered", F.array(F.lit("K1"), F.lit("K2")))
    got = {r.id: r for r in V.with_support(df, "raw", F.lit(context), F.col("offered")).collect()}
    fine = 0
    for i, raw in rows:
        want, r = supported(raw, context, ("K1", "K2")), got[i]
        assert r.parse_error == (want is None), raw
        if want:
            assert (r.normalized_fields, r.approach_match, [(s.supported, s.cited_items, s.item_supports) for s in r.support], r.faithfulness, r.citation_support) == want, raw
            fine += 1
    assert fine > 60


def test_items(spark):
    item = lambda i, label="RELEVANT", **k: {"idx": i, "label": label, **k}
    cases = [
        ({"items": [item(2, "PARTIAL", reason="r"), item(1)]}, [(1, "RELEVANT", ""), (2, "PARTIAL", "r")]), ({"items": [item(1), item(1)]}, None), ({"items": [item(1)]}, None),
        ({"items": [item(1), item(2, "relevant")]}, None), ({"items": [item(1), item(3)]}, None), ({"items": [item(1), 5]}, None), ({"items": [item(1), item("2")]}, None),
        ({"items": [item(1, reason=4), item(2)]}, [(1, "RELEVANT", ""), (2, "RELEVANT", "")]), ([], None), ({"items": {}}, None),
    ]
    rows = [(i, json.dumps(d), 2) for i, (d, _) in enumerate(cases)] + [(90, "```json\n" + json.dumps(cases[0][0]) + "\n```", 2), (91, None, 2), (92, '{"items": []}', 0)]
    got = {r.id: r["items"] and [tuple(x) for x in r["items"]] for r in V.validated_items(spark.createDataFrame(rows, "id long, raw string, k int"), "raw", "k", ("RELEVANT", "PARTIAL")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {90: cases[0][1], 91: None, 92: []}
