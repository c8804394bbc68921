"""Model answers: the object in a text, found by a scanner, and its check by name, type and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.spans import strip

# The fields of an answer, the longest list, and the recommendations (the first is the default).
TEXTS = ("company_overview", "founder_assessment", "product_assessment", "market_assessment", "traction_assessment", "financial_assessment", "valuation_assessment", "business_model_assessment", "competitive_assessment", "investment_thesis")
LISTS = ("strengths", "risks", "missing_information", "key_observations")
LONGEST = 3
RECOMMENDATION = "preliminary_recommendation"
RECOMMENDATIONS = ("insufficient_information", "promising", "needs_further_diligence", "concerns")

_SCALAR = r'^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity|"[^"\\\x00-\x1f]*")$'


def balanced_length(text: Column) -> Column:
    """How many characters the brackets that open a text run to; null if nothing closes them.

    One pass over escapes, quotes, brackets and what lies between, with depth
    and whether a string is open as its state.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)\\.?|"|[\[\]{}]|[^"\\\[\]{}]+'), F.lit(0))
    state = lambda depth, at, quoted, done: F.struct(depth.alias("depth"), at.alias("at"), quoted.alias("quoted"), done.alias("done"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = ~s["quoted"] & token.isin("{", "["), ~s["quoted"] & token.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.when(s["done"], s).otherwise(state(depth, s["at"] + F.char_length(token), s["quoted"] != (token == '"'), closes & (depth == 0)))

    end = F.aggregate(tokens, state(F.lit(0), F.lit(0), F.lit(False), F.lit(False)), step)
    return F.when(end["done"], end["at"])


def _decodes(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()


def _whole(text: Column, bracket: str) -> Column:
    """Whether the text, all of it, is a JSON object ("{") or list ("[")."""
    closed = F.startswith(text, F.lit(bracket)) & balanced_length(text).eqNullSafe(F.char_length(text))
    return closed & _decodes(text if bracket == "{" else F.concat(F.lit('{"a":'), text, F.lit("}")))


def first_object(text: Column) -> Column:
    """The first object in a text that decodes, as it stands there; null if none does."""
    parts = F.split(text, r"\{", -1)

    def at(found: Column, k: Column) -> Column:
        tail = F.concat(F.lit("{"), F.array_join(F.slice(parts, k, F.size(parts)), "{"))
        object_ = F.substring(tail, F.lit(1), balanced_length(tail))
        return F.coalesce(found, F.when(_decodes(object_), object_))  # once found, no later brace is tried

    braces = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts)))
    return F.aggregate(braces, F.lit(None).cast("string"), at)


def answer_object(text: Column) -> Column:
    """The JSON object in an answer, as text, or null where there is an error.

    Thoughts are removed.  If the whole is JSON it must be an object; else what
    is fenced must be one; else it is the first object in the text that decodes.
    """
    bare = strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    fence = r"(?isU)```(?:json)?\s*(.*?)\s*```"
    fenced = strip(F.regexp_extract(bare, fence, 1))
    return (
        F.when(_whole(bare, "{"), bare).when(_whole(bare, "[") | F.regexp_like(bare, F.lit(_SCALAR)), F.lit(None))
        .when(F.regexp_like(bare, F.lit(fence)), F.when(_whole(fenced, "{"), fenced)).otherwise(first_object(bare))
    )


def validate_answer(obj: Column) -> Column:
    """struct<ok, the fifteen fields> of an answer's object.

    Other names, a text that is none, a list that is none, is longer than
    LONGEST or holds anything but texts, and an unknown recommendation are not
    ok, and leave all fields null.  Texts are trimmed; absent lists are empty.
    An object that names a field twice is not ok.
    """
    value = F.try_parse_json(obj)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    text = lambda name: strip(F.try_variant_get(value, f"$.{name}", "string"))
    items = lambda name: F.try_variant_get(value, f"$.{name}", "array<string>")
    ok = value.isNotNull() & (F.size(F.array_except(F.json_object_keys(obj), F.array(*map(F.lit, (*TEXTS, *LISTS, RECOMMENDATION))))) == 0)
    for name in TEXTS:
        ok = ok & F.coalesce(kind(name), F.lit("VOID")).isin("STRING", "VOID")
    for name in LISTS:
        fits = kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(items(name)) <= LONGEST) & ~F.exists(items(name), lambda x: x.isNull())
        ok = ok & F.coalesce(fits, kind(name).isNull())
    said = F.try_variant_get(value, f"$.{RECOMMENDATION}", "string")
    ok = ok & F.coalesce(said.isin(*RECOMMENDATIONS) & (kind(RECOMMENDATION) == "STRING"), kind(RECOMMENDATION).isNull())
    fields = [F.when(ok, text(n)).alias(n) for n in TEXTS] + [F.when(ok, F.transform(F.coalesce(items(n), F.array().cast("array<string>")), strip)).alias(n) for n in LISTS]
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), *fields, F.when(ok, F.coalesce(said, F.lit(RECOMMENDATIONS[0]))).alias(RECOMMENDATION))
