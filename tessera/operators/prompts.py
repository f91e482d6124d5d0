"""Prompts of the routed search and of grounded answers, as column expressions.

The wording is a parameter of every function: responses are cached by prompt, so a cache made with other
templates needs those. Slots are named in braces and filled literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an answer says when the passages don't hold it, and the most claims of an answer and parts of a query.
REFUSAL, MAX_CLAIMS, MAX_PARTS = "INSUFFICIENT_CONTEXT", 8, 4
#: The answers asked for are the JSON shapes that ``functions.jsonx`` reads.
ROUTE = """Does the search query below need facts from more than one page of the documentation?
Say "decompose" if it compares things, names several of them or chains tasks; say "direct" if one page can answer it.

Query: {query}

Answer with one JSON object: {"route": "decompose" or "direct", "reason": "a few words"}"""
PARTS = """Write the search query below as at most {most} queries that can each be searched alone.
Keep its technical words, add no topic, use no pronouns for what another part names. A query of one part stays as it is.

Query: {query}

Answer with one JSON object: {"sub_queries": ["...", "..."]}"""
ANSWER = """Answer the question from the numbered passages and from nothing else, in at most 120 words.
End every sentence with the passages it rests on, like [C1] or [C2][C5]. If they don't hold the answer, refuse.

{context}

Question: {query}

Answer with one JSON object: {"refused": false, "answer": "..."}, or {"refused": true, "answer": "{refusal}"}"""
CLAIMS = """List the statements that the answer below makes, at most {most}, each complete in itself and without citation marks.
Add nothing and judge nothing.

Answer: {answer}

Answer with one JSON object: {"claims": ["...", "..."]}"""
SUPPORT = """For each numbered claim say whether a passage states it, and which. What no passage states isn't supported, true or not.

{context}

Claims:
{claims}

Answer with one JSON object: {"verdicts": [{"claim": 1, "supported": true, "passage": 3}, {"claim": 2, "supported": false, "passage": null}]}"""


def filled(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by its column's text; values are not searched for slots again."""
    parts: list[Column] = []
    rest = template
    while True:
        found = [(at, name) for name in values if (at := rest.find("{" + name + "}")) >= 0]
        if not found:
            return F.concat(*parts, F.lit(rest))
        at, name = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]


def route_requests(queries: DataFrame, model: str, template: str = ROUTE) -> DataFrame:
    """query_id, query, model, prompt: one verdict a query."""
    return queries.select("query_id", "query", F.lit(model).alias("model"), filled(template, query=F.col("query")).alias("prompt"))


def part_requests(routed: DataFrame, model: str, most: int = MAX_PARTS, template: str = PARTS) -> DataFrame:
    """The same for the queries that are to be decomposed."""
    rows = routed.where("route = 'decompose'")
    return rows.select("query_id", "query", F.lit(model).alias("model"), filled(template, query=F.col("query"), most=F.lit(most)).alias("prompt"))


def answer_requests(contexts: DataFrame, queries: DataFrame, model: str, retriever: str, template: str = ANSWER) -> DataFrame:
    """query_id, query, chunk_ids, model, retriever, prompt; contexts: query_id, chunk_ids, context. The retriever is part of the cache key."""
    rows = contexts.join(queries.select("query_id", "query"), "query_id")
    prompt = filled(template, context=F.col("context"), query=F.col("query"), refusal=F.lit(REFUSAL))
    return rows.select("query_id", "query", "chunk_ids", F.lit(model).alias("model"), F.lit(retriever).alias("retriever"), prompt.alias("prompt"))


def _checkable(answers: DataFrame) -> DataFrame:
    return answers.where(~F.col("refused") & (F.col("malformed") == "") & (F.coalesce("text", F.lit("")) != ""))


def claim_requests(answers: DataFrame, model: str, most: int = MAX_CLAIMS, template: str = CLAIMS) -> DataFrame:
    """system, query_id, query, model, retriever, prompt for every answer that was not refused, malformed or empty."""
    prompt = filled(template, answer=F.col("text"), most=F.lit(most))
    return _checkable(answers).select("system", "query_id", "query", F.lit(model).alias("model"), F.concat("system", F.lit(":claims")).alias("retriever"), prompt.alias("prompt"))


def support_requests(claimed: DataFrame, contexts: DataFrame, model: str, template: str = SUPPORT) -> DataFrame:
    """The same for the claims (claimed: system, query_id, query, claims) against their passages (contexts: system, query_id, context)."""
    listed = F.array_join(F.transform("claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    rows = claimed.where(F.size("claims") > 0).join(contexts.select("system", "query_id", "context"), ["system", "query_id"])
    prompt = filled(template, context=F.col("context"), claims=listed)
    return rows.select("system", "query_id", "query", F.lit(model).alias("model"), F.concat("system", F.lit(":support")).alias("retriever"), prompt.alias("prompt"))
