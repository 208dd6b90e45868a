"""Judges' answers as nested JSON: validation, repair of harmless slips, the label that follows from the claims.

Everything is expressions on the parsed value (VARIANT, so that a text "true" and a true stay apart) and on its array of claims. A record that
breaks a rule has parse_error and nulls instead of values; nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.operators.judging import ABSTAIN, FACTUAL, FULLY, PARTLY, ratio

# What may stand in the fields of a record.
LABELS = (FACTUAL, PARTLY, FULLY, ABSTAIN)
COMPLETENESS = ("FULL", "PARTIAL", "NONE")
VERDICTS, ERRORS = ("SUPPORTED", "CONTRADICTED", "FABRICATED", "UNVERIFIABLE"), ("CONTRADICTED", "FABRICATED")
SEVERITIES = ("CORE", "MINOR")
APPROACHES = ("SAME", "DIFFERENT_VALID", "DIFFERENT_UNASSESSABLE")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def upper(c: Column) -> Column:
    return F.upper(stripped(c))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column, name: str) -> Column:
    """BOOLEAN, STRING, VOID for a JSON null, ARRAY<...>, OBJECT<...> and so on; null where there is no such field."""
    return F.schema_of_variant(field(v, name, "variant"))


def noted(*notes: tuple[Column, str]) -> Column:
    """The names of the repairs that were made, in this order."""
    return F.filter(F.array(*[F.when(made, F.lit(name)) for made, name in notes]), lambda x: x.isNotNull())


def parsed_claim(c: Column, strict: bool) -> Column:
    """fine, verdict, severity, reference_conflict, notes of a claim. strict: a severity belongs to errors alone."""
    verdict = upper(field(c, "verdict"))
    kind, given = kind_of(c, "severity"), upper(field(c, "severity"))
    no_severity = kind.isNull() | (kind == "VOID")
    nullish = F.coalesce((kind == "STRING") & given.isin("NULL", "NONE"), F.lit(False))
    severity = F.when(~no_severity & ~nullish, given)
    error = verdict.isin(*ERRORS)
    misplaced = F.lit(strict) & ~error & severity.isNotNull()
    conflict, said = kind_of(c, "reference_conflict"), F.lower(stripped(field(c, "reference_conflict")))
    boolish = (conflict == "STRING") & said.isin("true", "false")
    refers = F.when(conflict.isNull(), F.lit(False)).when(conflict == "BOOLEAN", field(c, "reference_conflict", "boolean")).when(boolish, said == "true")
    fine = F.startswith(F.schema_of_variant(c), F.lit("OBJECT")) & verdict.isin(*VERDICTS) & F.coalesce(severity.isin(*SEVERITIES), F.lit(True)) & refers.isNotNull()
    notes = noted((nullish, "severity"), (F.coalesce(misplaced, F.lit(False)), "severity_on_non_error"), (F.coalesce(boolish, F.lit(False)), "reference_conflict"))
    return F.struct(F.coalesce(fine, F.lit(False)).alias("fine"), verdict.alias("verdict"), F.when(~misplaced, severity).alias("severity"), refers.alias("reference_conflict"), notes.alias("notes"))


def validated(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """df with parse_error, answer_attempted, completeness, claims (array of verdict, severity, reference_conflict), reported_label, label, consistent,
    conflict (claims though nothing was attempted), normalized_fields (a name a repair) and n_errors_without_severity.

    A text that isn't JSON is looked through for one object, from its first brace to its last. answer_attempted must be a
    boolean, claims an array of objects, verdicts, severities, completeness and the reported label among those that are fixed, in any case. A
    severity "null" or "none" is none; a conflict "true" or "false" is a boolean. The label is ABSTAIN without an attempt, else it follows from
    the gravest error. strict: the severity of a claim that is no error is dropped, too. Repeated keys make a text unreadable."""
    value = F.coalesce(F.try_parse_json(F.col(col)), F.try_parse_json(F.regexp_extract(col, r"(?s)\{.*\}", 0)))
    rows = df.withColumn("__v", value)
    v = F.col("__v")
    array = F.startswith(kind_of(v, "claims"), F.lit("ARRAY"))
    rows = rows.withColumn("__claims", F.when(array, F.transform(field(v, "claims", "array<variant>"), lambda c: parsed_claim(c, strict))))
    attempted = F.when(kind_of(v, "answer_attempted") == "BOOLEAN", field(v, "answer_attempted", "boolean"))
    # a null is spelt like the level that means nothing is complete
    complete = F.when(kind_of(v, "completeness") == "VOID", F.lit("NONE")).otherwise(upper(field(v, "completeness")))
    reported = upper(field(v, "label"))
    fine = F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & attempted.isNotNull() & complete.isin(*COMPLETENESS) & F.forall("__claims", lambda c: c["fine"]) & reported.isin(*LABELS)
    rows = rows.withColumn("__fine", F.coalesce(fine, F.lit(False))).withColumn("__attempted", attempted).withColumn("__complete", complete).withColumn("__reported", reported)
    ok = lambda c: F.when(F.col("__fine"), c)
    error = lambda c: c["verdict"].isin(*ERRORS)
    label = (
        F.when(~F.col("__attempted"), ABSTAIN).when(F.exists("__claims", lambda c: error(c) & F.coalesce(c["severity"] == "CORE", F.lit(False))), FULLY)
        .when(F.exists("__claims", error), PARTLY).otherwise(FACTUAL)
    )
    rows = rows.withColumn("__label", label)
    return rows.select(
        *[F.col(c) for c in df.columns],
        (~F.col("__fine")).alias("parse_error"), ok(F.col("__attempted")).alias("answer_attempted"), ok(F.col("__complete")).alias("completeness"),
        ok(F.transform("__claims", lambda c: F.struct(c["verdict"].alias("verdict"), c["severity"].alias("severity"), c["reference_conflict"].alias("reference_conflict")))).alias("claims"),
        ok(F.col("__reported")).alias("reported_label"), ok(F.col("__label")).alias("label"), ok(F.col("__reported") == F.col("__label")).alias("consistent"),
        ok(~F.col("__attempted") & (F.size("__claims") > 0)).alias("conflict"), ok(F.flatten(F.transform("__claims", lambda c: c["notes"]))).alias("normalized_fields"),
        ok(F.size(F.filter("__claims", lambda c: error(c) & c["severity"].isNull()))).alias("n_errors_without_severity"),
    )


def with_support(df: DataFrame, col: str, has_context: Column, offered: Column) -> DataFrame:
    """validated (strict) with approach_match, support (an array, for each claim: supported, cited_items, item_supports), faithfulness and citation_support.

    approach_match is needed with an attempt and dropped without one. With context a claim must be said to be supported by it
    or not (YES, NO); without, that is N/A. Cited items that weren't offered (an array of names) are dropped; what is left needs YES or
    NO on whether they support the claim, which is dropped where nothing is cited. Faithfulness: the share of claims that the
    context supports; citation support: of claims that cite something. Both need an attempt and a denominator."""
    rows = validated(df.withColumn("__context", has_context).withColumn("__offered", offered), col, True)
    value = F.coalesce(F.try_parse_json(F.col(col)), F.try_parse_json(F.regexp_extract(col, r"(?s)\{.*\}", 0)))
    rows = rows.withColumn("__v", F.when(~F.col("parse_error"), value))
    none = lambda c: F.when(~c.isin("", "NULL", "NONE"), c)
    approach = none(upper(field(F.col("__v"), "approach_match")))
    context, attempted = F.col("__context"), F.col("answer_attempted")

    def support(c: Column) -> Column:
        said, kind = none(upper(field(c, "supported_by_context"))), kind_of(c, "cited_items")
        # falsy values stand for no items
        listed = F.startswith(kind, F.lit("ARRAY"))
        empty = kind.isNull() | (kind == "VOID") | field(c, "cited_items").isin("", "0", "0.0", "false", "{}")
        names = F.transform(F.coalesce(F.when(listed, field(c, "cited_items", "array<string>")), F.array().cast("array<string>")), lambda k: F.upper(F.trim(stripped(F.coalesce(k, F.lit("None"))), F.lit("[]"))))
        items = F.filter(names, lambda k: F.array_contains(F.col("__offered"), k))
        verdict = none(upper(field(c, "cited_item_supports")))
        fine = (listed | empty) & (~context | F.coalesce(said.isin("YES", "NO"), F.lit(False))) & ((F.size(items) == 0) | F.coalesce(verdict.isin("YES", "NO"), F.lit(False)))
        notes = F.concat(noted((~context & F.coalesce(said != "N/A", F.lit(True)), "supported_by_context_without_context")), F.transform(F.filter(names, lambda k: ~F.array_contains(F.col("__offered"), k)), lambda k: F.lit("cited_item_not_offered")), noted(((F.size(items) == 0) & verdict.isNotNull(), "cited_item_supports_without_citation")))
        return F.struct(F.coalesce(fine, F.lit(False)).alias("fine"), F.when(context, said).otherwise("N/A").alias("supported"), items.alias("cited_items"), F.when(F.size(items) > 0, verdict).alias("item_supports"), notes.alias("notes"))

    rows = rows.withColumn("__s", F.transform(field(F.col("__v"), "claims", "array<variant>"), support)).withColumn("__approach", approach)
    fine = ~F.col("parse_error") & F.forall("__s", lambda c: c["fine"]) & (~attempted | F.coalesce(F.col("__approach").isin(*APPROACHES), F.lit(False)))
    rows = rows.withColumn("__ok", F.coalesce(fine, F.lit(False)))
    ok = lambda c: F.when(F.col("__ok"), c)
    count = lambda test: F.size(F.filter("__s", test))
    notes = F.concat("normalized_fields", noted((~attempted & F.col("__approach").isNotNull(), "approach_match_on_abstain")), F.flatten(F.transform("__s", lambda c: c["notes"])))
    faithful = F.when(context & attempted, ratio(count(lambda c: c["supported"] == "YES"), F.size("__s")))
    cited = F.when(attempted, ratio(count(lambda c: (F.size(c["cited_items"]) > 0) & (c["item_supports"] == "YES")), count(lambda c: F.size(c["cited_items"]) > 0)))
    kept = [c for c in rows.columns if not c.startswith("__") and c not in (*df.columns, "parse_error", "normalized_fields")]
    return rows.select(
        *df.columns, (~F.col("__ok")).alias("parse_error"), *[ok(F.col(c)).alias(c) for c in kept], ok(notes).alias("normalized_fields"),
        ok(F.when(attempted, F.col("__approach"))).alias("approach_match"),
        ok(F.transform("__s", lambda c: F.struct(c["supported"].alias("supported"), c["cited_items"].alias("cited_items"), c["item_supports"].alias("item_supports")))).alias("support"),
        ok(F.round(faithful, 4)).alias("faithfulness"), ok(F.round(cited, 4)).alias("citation_support"),
    )


def validated_items(df: DataFrame, col: str, n: str, labels: tuple[str, ...]) -> DataFrame:
    """df with items: an array of idx, label, reason for 1 to n in order, or null. The text, which may stand in a fenced block, must be
    an object whose items have each of these numbers once and a label among those given, as it is; a reason that is no text is empty."""
    bare = F.regexp_replace(stripped(F.col(col)), r"(?s)^```[a-zA-Z]*\s*\n?|\n?```$", "")
    rows = df.withColumn("__v", F.try_parse_json(bare))
    array = F.startswith(kind_of(F.col("__v"), "items"), F.lit("ARRAY"))
    item = lambda c: F.struct(
        F.when(F.startswith(kind_of(c, "idx"), F.lit("BIGINT")), field(c, "idx", "bigint")).alias("idx"),
        F.when(kind_of(c, "label") == "STRING", field(c, "label")).alias("label"),
        F.when(kind_of(c, "reason") == "STRING", field(c, "reason")).otherwise("").alias("reason"),
    )
    rows = rows.withColumn("__i", F.when(array, F.array_sort(F.transform(field(F.col("__v"), "items", "array<variant>"), item))))
    numbers = F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    fine = (F.transform("__i", lambda i: i["idx"]) == numbers) & F.forall("__i", lambda i: F.coalesce(i["label"].isin(*labels), F.lit(False)))
    return rows.withColumn("items", F.when(fine, F.col("__i"))).drop("__v", "__i")
