"""Reading the JSON answers of a language model, with types checked, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routes, and how many sub-queries and claims are kept.
ROUTES, MAX_SUB_QUERIES, MAX_CLAIMS = ("decompose", "direct"), 3, 8
#: The marker a refusal must hold; a parameter of the prompts that are used.
REFUSAL_MARKER = "INSUFFICIENT_CONTEXT"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def whole_object(text: str | Column) -> Column:
    """The JSON object that the text is; null if it is not one."""
    v = F.try_parse_json(_c(text))
    return F.when(_kind(v).startswith("OBJECT"), v)


def first_object(text: str | Column) -> Column:
    """The JSON object from the first brace to the last, in whatever prose or fence it stands; null if there is none."""
    return whole_object(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0))


def string_at(v: Column, key: str) -> Column:
    """A string member, trimmed; null if it is missing or of another type."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(_kind(x) == "STRING", F.trim(F.try_variant_get(v, f"$.{key}", "string")))


def boolean_at(v: Column, key: str) -> Column:
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(_kind(x) == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))


def list_at(v: Column, key: str) -> Column:
    """A list member as array of variants; null if it is missing or of another type."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(_kind(x).startswith("ARRAY"), F.try_variant_get(v, f"$.{key}", "array<variant>"))


def strings_of(items: Column) -> Column:
    """The strings among variants, trimmed, without empty ones."""
    kept = F.filter(items, lambda x: _kind(x) == "STRING")
    return F.filter(F.transform(kept, lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda s: s != "")


def parse_route(text: str | Column) -> Column:
    """struct(route, reason); null if the answer names no route."""
    v = first_object(text)
    route = F.lower(string_at(v, "route"))
    return F.when(route.isin(*ROUTES), F.struct(route.alias("route"), F.coalesce(string_at(v, "reason"), F.lit("")).alias("reason")))


def parse_sub_queries(text: str | Column, most: int = MAX_SUB_QUERIES) -> Column:
    """Up to ``most`` different strings; null if the answer holds none."""
    found = F.slice(F.array_distinct(strings_of(list_at(first_object(text), "sub_queries"))), 1, most)
    return F.when(F.size(found) > 0, found)


def parse_answer(raw: str | Column, k: str | Column, marker: str = REFUSAL_MARKER) -> Column:
    """struct(refused, text, cited, dangling, malformed) of a generated answer over ``k`` passages.

    The refused flag and the marker in the text must agree; otherwise the answer is malformed, as it
    is without a text or a flag. ``[C1]`` cites passage 1; numbers beyond k dangle.
    """
    v = whole_object(raw)
    text, flag = string_at(v, "answer"), boolean_at(v, "refused")
    marked = F.coalesce(text.contains(marker), F.lit(False))
    malformed = (
        F.when(v.isNull(), "no JSON object").when(text.isNull(), "no string 'answer'").when(flag.isNull(), "no boolean 'refused'")
        .when(flag != marked, F.concat(F.lit("refused="), flag.cast("string"), F.lit(", marker="), marked.cast("string"))).otherwise("")
    )
    plain = (malformed == "") & ~flag
    numbers = F.when(plain, F.transform(F.regexp_extract_all(text, F.lit(r"\[C(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))).otherwise(F.array().cast("array<int>"))
    inside = lambda n: (n >= 1) & (n <= _c(k))
    return F.struct(
        F.coalesce(flag, F.lit(False)).alias("refused"), F.coalesce(text, F.lit("")).alias("text"), F.filter(numbers, inside).alias("cited"), F.filter(numbers, lambda n: ~inside(n)).alias("dangling"), malformed.alias("malformed")
    )


def cited_chunks(cited: str | Column, chunk_ids: str | Column) -> Column:
    """Ids of the cited passages in the order of citation, each once."""
    return F.array_distinct(F.transform(_c(cited), lambda n: F.element_at(_c(chunk_ids), n)))


def parse_claims(raw: str | Column, most: int = MAX_CLAIMS) -> Column:
    """struct(claims, error): up to ``most`` claims; an error text if there are none."""
    v = whole_object(raw)
    items = list_at(v, "claims")
    claims = F.coalesce(F.slice(strings_of(items), 1, most), F.array().cast("array<string>"))
    error = F.when(v.isNull() | items.isNull(), "no 'claims' list").when(F.size(claims) == 0, "no usable claims").otherwise("")
    return F.struct(claims.alias("claims"), error.alias("error"))


def parse_verdicts(raw: str | Column, claims: str | Column, k: str | Column) -> Column:
    """Array of struct(claim, supported, passage, judged), one a claim, aligned by the 1-based numbers in the answer.

    The first verdict of a number counts. A claim without one is unsupported and not judged. A passage
    counts only as a number from 1 to k. As in the answers' own reading, any non-empty value of
    ``supported`` other than false, 0 and null is true, and a number may be given as a string.
    """
    items = F.coalesce(list_at(whole_object(raw), "verdicts"), F.array().cast("array<variant>"))
    truth = lambda x: (
        F.when(_kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string") != "")
        .when(_kind(x).isin("BIGINT", "DOUBLE") | _kind(x).startswith("DECIMAL"), F.try_variant_get(x, "$", "double") != 0)
        .when(x.isNull() | (_kind(x) == "VOID"), F.lit(False)).otherwise(~_kind(x).isin("ARRAY<VOID>", "OBJECT<>"))
    )

    def one(x: Column) -> Column:
        number = F.try_variant_get(x, "$.claim", "int")
        passage = F.try_variant_get(x, "$.passage", "variant")
        at = F.when(_kind(passage) == "BIGINT", F.try_variant_get(x, "$.passage", "int"))
        return F.named_struct(F.lit("n"), number, F.lit("supported"), F.coalesce(truth(F.try_variant_get(x, "$.supported", "variant")), F.lit(False)), F.lit("passage"), F.when((at >= 1) & (at <= _c(k)), at))

    rows = F.transform(F.filter(items, lambda x: _kind(x).startswith("OBJECT")), one)

    def aligned(claim: Column, i: Column) -> Column:
        first = F.get(F.filter(rows, lambda r: r["n"] == i + 1), F.lit(0))
        return F.named_struct(F.lit("claim"), claim, F.lit("supported"), F.coalesce(first["supported"], F.lit(False)), F.lit("passage"), first["passage"], F.lit("judged"), first.isNotNull())

    return F.transform(_c(claims), aligned)
