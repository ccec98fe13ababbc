"""JSON in answers of models, and the answers of re-rankers, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fenced block, how often a string in a string is taken out, fields of a score.
FENCE = r"(?m)^```(?:json|JSON)?[ \t]*\n([\s\S]*?)```[ \t]*$"
DECODINGS = 3
SCORE_FIELDS = ("relevance_score", "score", "relevance")

STRING = r'(?s)^"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"$'
STRICT = {"allowSingleQuotes": "false"}


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` worked out once, however often it is used."""
    return F.transform(F.array(c), use)[0]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    Readers stop after the first value, so the text is read as the first of two entries, the second of
    which it can't hold itself: its own hash.
    """
    seal = F.sha2(c, 256)
    read = F.from_json(F.concat(F.lit("["), c, F.lit(',"'), seal, F.lit('"]')), "array<string>", STRICT)
    return F.coalesce((F.size(read) == 2) & (F.try_element_at(read, F.lit(2)) == seal), F.lit(False))


def string_taken_out(c: Column) -> Column:
    """The text of a JSON string; any other text as it is."""
    taken = lambda inner, outer: F.when(inner.rlike(STRING), F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>", STRICT)[0]).otherwise(outer)
    return _once(c, lambda outer: _once(stripped(outer), lambda inner: taken(inner, outer)))


def model_json(answer: Column) -> Column:
    """The JSON of a model's answer: out of a fenced block, of strings in strings, of words around it.

    Curved quotation marks become straight ones in what has JSON's brackets. What holds no JSON comes
    back trimmed, null as an empty text.
    """
    text = _once(stripped(F.coalesce(answer, F.lit(""))), lambda t: F.when(t.rlike(FENCE), stripped(F.regexp_extract(t, FENCE, 1))).otherwise(t))
    for _ in range(DECODINGS):
        text = string_taken_out(text)
    straight = lambda c: F.translate(c, "“”", '""')
    # from the first bracket to the last that closes its kind
    inside = lambda t: F.when(F.regexp_extract(t, r"[{\[]", 0) == "{", F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(t, r"(?s)(\[.*\])", 1))
    among_words = lambda t: _once(inside(t), lambda x: F.when((x != "") & is_json(x), straight(x)).otherwise(t))
    return _once(stripped(text), lambda t: F.when(t.rlike(r"^[{\[]"), straight(t)).otherwise(among_words(t)))


def _number(v: Column, whole_text: bool = False) -> Column:
    """A variant's number: numbers, booleans, and texts of one (of a whole one, if asked so)."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    pattern = r"^\s*[+-]?\d+\s*$" if whole_text else r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    plain = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN|INT|SMALLINT|TINYINT)")
    return F.when(plain, F.try_variant_get(v, "$", "double")).when((kind == "STRING") & text.rlike(pattern), F.trim(text).try_cast("double"))


def _counts(v: Column) -> Column:
    """Whether a score's value is used: not null, zero, false or empty."""
    return F.coalesce(~F.to_json(v).isin('""', "false", "null", "[]", "{}") & ~F.coalesce(_number(v) == 0, F.lit(False)) | (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != ""), F.lit(False))


def rerank_entries(response: Column) -> Column:
    """The entries of a re-ranker's response, in any of its three shapes; null if it has none of them."""
    v = F.try_parse_json(response)
    return F.coalesce(*[F.try_variant_get(v, path, "array<variant>") for path in ("$.output.results", "$.results", "$.data")])


def rerank_scores(response: Column, candidates: Column) -> Column:
    """Array of index and score of a response's entries; null for a response of no known shape.

    Entries without an index of a candidate (0 up to ``candidates``) are left out. A score is the first
    of its fields that is not null, zero or empty; what is no number is 0.
    """
    fields = lambda e: [F.try_variant_get(e, f"$.{f}", "variant") for f in SCORE_FIELDS]

    def score(e: Column) -> Column:
        chosen = F.coalesce(*[F.when(_counts(x), x) for x in fields(e)])
        return F.coalesce(_number(chosen), F.lit(0.0))

    read = F.transform(rerank_entries(response), lambda e: F.struct(_number(F.try_variant_get(e, "$.index", "variant"), True).cast("long").alias("index"), score(e).alias("score")))
    return F.filter(read, lambda e: (e["index"] >= 0) & (e["index"] < candidates))
