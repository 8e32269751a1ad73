"""Prompts from retrieved chunks: token budget, templates, answers, sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import count_tokens
from folio.operators.normalize import Config, Records, normalize


@dataclass(frozen=True)
class Template:
    """Texts with the places ``{question}`` and those of the variables; ``each`` also has ``{citation}`` and ``{text}``."""

    name: str
    system: str
    head: str
    each: str
    tail: str
    top_k: int = 5
    max_tokens: int = 0
    variables: dict[str, str] = field(default_factory=dict)
    repair: Config = field(default_factory=Config)


QA = Template(
    "qa",
    system="Answer the question from the context alone, and say so plainly if the context does not answer it.\n",
    head="Question:\n\n{question}\n\nContext:\n\n",
    each="\nSource: {citation}\n\n{text}\n\n",
    tail="",
)
BRIEF = Template(
    "brief",
    system="Answer from the context alone, in at most 280 characters and without filler. If it has no answer, reply: Not in notes.\n",
    head="Question: {question}\n\nContext:\n",
    each="\nSource: {citation}\n{text}\n",
    tail="\n\nYour reply, 280 characters at most and in note form:\n",
    max_tokens=280,
)
ANKI = Template(
    "anki",
    system="Write flashcards from the context and nothing else. Each card: a line of four hyphens, an empty line, the question, a note or an empty line, the answer with one item a line, an empty line.\n",
    head="Topic: {question}\n\nContext:\n\n",
    each="\nSource: {citation}\n\n{text}\n\n",
    tail="\n\nFlashcards:\n",
    top_k=10,
    max_tokens=4096,
    repair=Config(("strip_preamble", "strip_fences", "strip_headings", "strip_list_markers", "collapse_blank_lines"), Records("----", ("lead", "note", "body"))),
)
TEMPLATES = {t.name: t for t in (QA, BRIEF, ANKI)}


def within_budget(retrieved: DataFrame, max_tokens: int) -> DataFrame:
    """Each query's chunks by rank while their tokens add up to at most ``max_tokens``; the first always stays."""
    if max_tokens <= 0:
        return retrieved
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(count_tokens(F.col("text"))).over(by_rank)
    return retrieved.withColumn("_spent", spent).where((F.col("rank") == 1) | (F.col("_spent") <= max_tokens)).drop("_spent")


def _filled(template: str, places: dict[str, Column]) -> Column:
    """The template with its places filled; parts that are filled in are not searched for places again."""
    parts: list[Column | str] = [template]
    for name, value in places.items():
        cut: list[Column | str] = []
        for part in parts:
            if isinstance(part, str):
                pieces = part.split("{" + name + "}")
                for i, piece in enumerate(pieces):
                    cut += [value] * (i > 0) + [piece]
            else:
                cut.append(part)
        parts = cut
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts], F.lit(""))


def render_prompts(queries: DataFrame, retrieved: DataFrame, template: Template, variables: dict[str, str] | None = None, require_context: bool = False) -> DataFrame:
    """``query_id, status, n_chunks, citations, system, user`` for ``queries(query_id, text)``: a row a query.

    A query without context keeps its row: ``status`` is 'empty', or 'error' if context is required.
    """
    given = {k: F.lit(v) for k, v in {**template.variables, **(variables or {})}.items()}
    grouped = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))).alias("found"))
    rows = queries.select("query_id", F.col("text").alias("question")).join(grouped, "query_id", "left")
    found = F.coalesce("found", F.array().cast("array<struct<rank: int, citation: string, text: string>>"))
    rows = rows.select("query_id", "question", found.alias("found"))
    question = {"question": F.col("question"), **given}
    each = F.transform("found", lambda c: _filled(template.each, {**question, "citation": c["citation"], "text": c["text"]}))
    empty = "error" if require_context else "empty"
    return rows.select(
        "query_id",
        F.when(F.size("found") > 0, "ready").otherwise(empty).alias("status"),
        F.size("found").alias("n_chunks"),
        F.transform("found", lambda c: c["citation"]).alias("citations"),
        _filled(template.system, question).alias("system"),
        F.concat(_filled(template.head, question), F.array_join(each, ""), _filled(template.tail, question)).alias("user"),
    )


def sources_footer(citations: Column) -> Column:
    """The numbered sources, '' if there are none."""
    lines = F.transform(citations, lambda c, i: F.format_string("  [%d] %s\n", i + 1, c))
    return F.when(F.size(citations) > 0, F.concat(F.lit("\nSources:\n"), F.array_join(lines, ""))).otherwise("")


def with_line_end(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def answer(prompts: DataFrame, chat: Callable[[str, str], str]) -> DataFrame:
    """``prompts`` with ``answer`` and ``error`` from ``chat(system, user)``; rows with an error status are not asked."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string, error string"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            answers: list[str | None] = []
            errors: list[str | None] = []
            for status, system, user in zip(col("status"), col("system"), col("user"), strict=True):
                got, problem = None, None
                if status != "error":
                    try:
                        got = chat(system, user)
                    except Exception as e:  # noqa: BLE001  a model's failure is a row's error
                        problem = f"{type(e).__name__}: {e}"
                answers.append(got)
                errors.append(problem)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "answer", "error"])

    return prompts.mapInArrow(asked, schema)


def finished(answers: DataFrame, template: Template) -> DataFrame:
    """``answers`` with ``output``: repaired, ended by a line end, and with its sources; records stay byte-exact, without."""
    text = normalize(F.col("answer"), template.repair)
    if template.repair.records:
        return answers.withColumn("output", text)
    return answers.withColumn("output", F.concat(with_line_end(text), sources_footer(F.col("citations"))))
