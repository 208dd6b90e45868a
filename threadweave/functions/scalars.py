"""Column expressions: trust weights, text, sets and vectors. All stay inside the JVM and code generation."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Weights of the trust formulas.
ANSWER_WEIGHTS = (0.5, 0.3, 0.2)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def present(col: str) -> Column:
    """Neither null nor 0, which stands for none."""
    return F.col(col).isNotNull() & (F.col(col) != 0)


def norm_log(x: Column, top: Column) -> Column:
    """log(1 + max(x, 0)) against that of `top`, within 0 and 1; null counts as 0."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))) / F.log1p(top))


def trust_answer(score: Column, accepted: Column, author: Column) -> Column:
    return ANSWER_WEIGHTS[0] * score + ANSWER_WEIGHTS[1] * accepted.cast("double") + ANSWER_WEIGHTS[2] * F.coalesce(author, F.lit(0.0))


def corrected_trust(trust: Column, author: Column) -> Column:
    """A stored trust whose author part was a constant 0.5, with the author's weight in its place, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust - 0.1 + 0.2 * author))


def min_max(col: Column, by: list[str], constant: float) -> Column:
    """Min-max over the group; `constant` where all values are equal (threads 0.5, queries 1.0)."""
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high == low, F.lit(constant)).otherwise((col - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-9)))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """both_empty: 1.0 for sets of chosen ids; 0.0 for tags."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tags(col: Column) -> Column:
    """`<a><b>` as an array."""
    return F.regexp_extract_all(col, F.lit("<([^<>]+)>"), F.lit(1))


def first_tag(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, "<([^<>]+)>", 1), F.lit(""))


# The tags that end a line.
LINE_ENDS = r"(?i)</(p|div|li|pre|blockquote|h[1-6])\s*>|<br\s*/?>"


CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no function for it."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def unescaped_if_closed(texts: pd.Series) -> pd.Series:
    """Only references that end in a semicolon decoded; one that was cut off stays as it is written."""
    return texts.map(lambda t: CLOSED.sub(lambda m: html.unescape(m.group()), t), na_action="ignore")


def html_to_text(col: Column, most: int = 4000, unescaped: Callable[[Column], Column] = unescaped) -> Column:
    """Closing block tags and <br> to line breaks, other tags away (their text stays), character references decoded, blanks
    collapsed, at most one empty line in a row, cut to `most` characters with a mark. A null is an empty text."""
    # fixed values, and their order
    out = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), LINE_ENDS, "\n"), "<[^>]+>", "")
    out = F.regexp_replace(F.regexp_replace(unescaped(out), "[ \t]+", " "), "\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"^[\s\u00A0]+|[\s\u00A0]+$", "")
    cut = F.regexp_replace(F.substring(out, 1, most), r"[\s\u00A0]+$", "")
    return F.when(F.length(out) > most, F.concat(cut, F.lit(" …[truncated]"))).otherwise(out)


# How citations are written. A token is any bracket that begins as one; only digits name a source.
CITATION, CITATION_TOKEN = r"(?i)\[SO[-: ]?(?:thread\s*)?(\d+)\]", r"(?i)\[SO(?=[-:\s<\]])[^\]]{0,20}\]"


def citation_tokens(col: Column) -> Column:
    """Everything that is written like a citation, placeholders too, repeats too."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(CITATION_TOKEN), F.lit(0))


def valid_citations(col: Column, context_ids: Column) -> Column:
    """The ids of tokens that name one of context_ids, repeats too."""
    ids = F.transform(citation_tokens(col), lambda x: F.regexp_extract(x, f"^{CITATION}$", 1).try_cast("bigint"))
    return F.filter(ids, lambda x: F.coalesce(F.array_contains(context_ids, x), F.lit(False)))


def sentences(col: Column) -> Column:
    """Sentences and lines of a text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x) != "")


def cited_statements(col: Column) -> Column:
    """Of each sentence with a citation: statement (tokens taken out) and cited ids."""
    cited = F.filter(sentences(col), lambda x: F.size(citation_tokens(x)) > 0)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, CITATION_TOKEN, ""), "[ \t]{2,}", " "), "[ \t]+([,.;:!?])", "$1"))
    ids = lambda x: F.transform(F.regexp_extract_all(x, F.lit(CITATION), F.lit(1)), lambda i: i.cast("bigint"))
    return F.transform(cited, lambda x: F.struct(bare(x).alias("statement"), ids(x).alias("ids")))


def blinded(col: Column) -> Column:
    """The text without citations and without a block of sources at its end, so that its origin can't be told."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?is)\n+\s*\**\s*(sources|references)\s*:?\s*\**\s*:?\s*\n.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, CITATION_TOKEN, ""), "[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")


# What an answer calls its context, phrases about it by name, in order, and what stands in their place.
MARKER = "[catatan: informasi tidak tersedia]"
_SOURCES = (
    r"(?:(?:the|your)\s+)?(?:retrieved|provided|given|available|supplied)\s+(?:sources?|contexts?|documents?|excerpts?|snippets|search\s+results|information|materials?)"
    r"|the\s+(?:sources?|contexts?|excerpts?|search\s+results)(?:\s+(?:you\s+)?(?:provided|given|retrieved|supplied))?"
)
_OTHER_OF = r"(?!\s+of\b)"
_LEAD = r"(?:(?:unfortunately|however|therefore|in\s+summary|that\s+said|note\s+that),?\s+|(?:since|while|as|although)\s+)?"
_DO_NOT = r"(?:,\s*however,)?\s*(?:do|does|did)\s*(?:not|n't)\s+(?:\w+ly\s+)?(?:cover|provide|address|mention|include|contain|discuss|specify|offer|detail|describe|explain|give|confirm|answer|support|state|have)"
_SAY = r"(?:(?:do|does)\s+)?(?:suggest|indicate|mention|state|recommend|support|show|confirm|note|provide|cover|describe|explain|highlight|discuss)(?:e?s)?"
PHRASES = [
    ("sources_do_not_cover", rf"\b{_LEAD}(?:{_SOURCES}){_OTHER_OF}\s*{_DO_NOT}\b", MARKER),
    ("no_information_in_sources", rf"\bthere\s+(?:is|are)\s+no\s+(?:\w+\s+){{0,2}}(?:in|from|within)\s+(?:{_SOURCES}){_OTHER_OF}(?:\s+(?:about|on|regarding))?\b", MARKER),
    ("not_covered_in_sources", rf"(\b(?:is|are|was|were)\s*(?:not|n't)\s+(?:\w+ly\s+)?(?:covered|mentioned|addressed|discussed|described|specified|provided|supported|confirmed))\s+(?:in|by)\s+(?:{_SOURCES}){_OTHER_OF}\b", "$1"),
    ("attribution_prefix", rf"\b(?:according\s+to|based\s+on|as\s+(?:mentioned|noted|shown|described|stated|indicated|suggested)\s+(?:in|by)|from|per|in)\s+(?:{_SOURCES}){_OTHER_OF},?\s*", ""),
    ("beyond_sources", rf"\s+beyond\s+(?:{_SOURCES}){_OTHER_OF}", ""),
    ("sources_say", rf"\b(?:{_SOURCES}){_OTHER_OF}\s+(?:\w+ly\s+)?{_SAY}(?:\s+that)?:?\s*", ""),
]
_UNICODE = "(?iuU)"


def phrases_replaced(col: Column) -> tuple[Column, Column]:
    """The text without phrases about its sources, and the phrases: an array of name and phrase (as it is written), in order."""
    done = without_phrases(col)
    return done["text"], done["hits"]


def without_phrases(col: Column) -> Column:
    """phrases_replaced as a struct of text and hits. Each step's text is computed once: a chain of expressions that name the one
    before twice would double with every pattern."""
    named = lambda name, hits: F.transform(hits, lambda x: F.struct(F.lit(name).alias("name"), x.alias("phrase")))
    step = lambda text, hits: F.struct(text.alias("text"), hits.alias("hits"))

    def applied(at: int, so_far: Column) -> Column:
        if at == len(PHRASES):
            return so_far
        name, pattern, instead = PHRASES[at]
        hits = lambda s: F.concat(s["hits"], named(name, F.regexp_extract_all(s["text"], F.lit(_UNICODE + pattern), F.lit(0))))
        return applied(at + 1, let(so_far, lambda s: step(F.regexp_replace(s["text"], _UNICODE + pattern, instead), hits(s))))

    return applied(0, step(col, F.array().cast("array<struct<name:string,phrase:string>>")))


def tidied(col: Column) -> Column:
    """Blanks collapsed and taken off before punctuation, stray commas gone, small letters (a-z) at a sentence's start made great."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "[ \t]{2,}", " "), "[ \t]+([,.;:!?])", "$1"), ",([.;:!?])", "$1")

    def great(parts: Column) -> Column:
        begins = lambda i: (i == 0) | F.get(parts, i - 1).rlike(r"(?U)([.!?]\s+|\n)$")
        return F.transform(parts, lambda x, i: F.when(begins(i) & x.rlike("^[a-z]"), F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))).otherwise(x))

    return F.regexp_replace(F.array_join(let(F.split(out, r"(?U)(?<=\s)(?=[a-z])"), great), ""), r"(?U)^\s+|\s+$", "")


def blinded_with_hits(col: Column) -> Column:
    """blinded, and without phrases about sources, as a struct of text and hits; what has none of them isn't tidied."""
    text = lambda b, done: F.when(F.size(done["hits"]) > 0, tidied(done["text"])).otherwise(b)
    return let(blinded(col), lambda b: let(without_phrases(b), lambda done: F.struct(text(b, done).alias("text"), done["hits"].alias("hits"))))


def blinded_fully(col: Column) -> Column:
    return blinded_with_hits(col)["text"]


def cited_ids(col: Column) -> Column:
    """Ids in citations such as [answer_id: 12]."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"(?i)\[\s*answer_id\s*[:=]\s*(\d+)\s*\]"), F.lit(1)), lambda x: x.cast("bigint"))


def redacted(col: Column) -> Column:
    """Secrets as ***: keys after a name, e-mail addresses, IPv4 addresses."""
    out = F.regexp_replace(col, r'(?i)\b(token|api[_-]?key|secret|password)(\s*[=:]\s*)"?[A-Za-z0-9_\-]{16,}"?', "$1$2***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "***")
    return F.regexp_replace(out, r"\b\d{1,3}(\.\d{1,3}){3}\b", "***")


# What tells the kinds of questions apart.
DEBUGGING = r"(?i)\b(error|exception|bug|fix|fails?|failing|crash|traceback|not working|doesn't work|why (is|does|isn't)|issue|problem)\b"
HOW_TO = r"(?i)^\s*(how (do|can|to|should)|what('s| is) the best way to)"


def question_type(title: Column, body: Column) -> Column:
    """Debugging (by title or body) before How-to (by the title's beginning) before Conceptual."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return F.when(text.rlike(DEBUGGING), "Debugging").when(F.coalesce(title, F.lit("")).rlike(HOW_TO), "How-to").otherwise("Conceptual")


def hash_order(seed: int, *cols: str) -> Column:
    """A fixed pseudo-random order of keys: samples by it are seeded, nested and disjoint, on any engine with MD5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
