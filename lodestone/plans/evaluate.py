"""Retrieval evaluation: label checks, budgeted requests, scored runs and run comparison."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import MIN_CONTEXT_CHARS, parse_request
from ..errors import RetrievalError, compact_json, utf16_units
from ..operators import coverage, maintenance, metrics
from ..operators.bootstrap import DEFAULT_ITERATIONS, DEFAULT_SEED, scoped_bootstrap
from ..functions.preview import escaped_cost
from ..functions.text import escape_cost, is_blank
from ..session import cut_lineage

DATASET_SCHEMA = """version int, name string, split string, scenario struct<id:string,kind:string>,
  corpus array<struct<collection_id:string,path:string,sha256:string>>,
  facts array<struct<id:string,evidence:array<struct<collection_id:string,path:string,start_line:int,end_line:int,quote:string>>>>,
  questions array<struct<id:string,intent_group:string,type:string,query:string,required_facts:array<string>,no_answer:boolean,
    subquestions:array<struct<id:string,text:string,required_facts:array<string>>>>>"""

RESPONSE_SCHEMA = """status string, results array<struct<chunk_id:string,text:string,start_line:int,end_line:int,section_start_line:int,section_end_line:int,source_id:string,
  collection_id:string,path:string,source_version:string,matched_query_ids:array<string>,text_truncated:boolean,
  preview_range:struct<start_line:int,start_column:int,end_line:int,end_column:int>>>"""


class EvaluationDataset:
    """A frozen dataset as DataFrames: corpus, facts (one row per anchor) and questions."""

    def __init__(self, spark: SparkSession, path: str):
        raw = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(DATASET_SCHEMA).json(path)
        self.corpus = raw.select(F.inline("corpus"))
        facts = raw.select(F.explode("facts").alias("f")).select(F.col("f.id").alias("fact_id"), F.posexplode("f.evidence").alias("alternative", "e"))
        self.anchors = facts.select("fact_id", "alternative", "e.*")
        questions = raw.select(F.posexplode("questions").alias("ord", "q")).select("ord", "q.*")
        self.questions = questions.withColumns(
            {"no_answer": F.coalesce("no_answer", F.lit(False)), "query_id": F.col("id")}
        ).drop("id")
        self.required = self.questions.select("query_id", F.explode("required_facts").alias("fact_id"))


def label_problems(dataset: EvaluationDataset, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """Every broken label as (kind, id); an empty result means the dataset is valid.

    ``sources``: source_id, collection_id, relative_path, source_version, first_line,
    last_line. ``lines``: source_id, line_no, text.
    """
    def flag(df: DataFrame, kind: str, column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), column.cast("string").alias("id"))

    manifest = sources.select("collection_id", F.col("relative_path").alias("path"), F.col("source_version").alias("sha256"))
    found = flag(maintenance.same_rows(dataset.corpus, manifest), "corpus differs from manifest", F.col("path"))
    anchors = dataset.anchors.join(
        sources.select("source_id", "collection_id", F.col("relative_path").alias("path"), "first_line", "last_line"),
        ["collection_id", "path"], "left",
    )
    key = ["fact_id", "alternative"]
    spans = anchors.filter(F.col("end_line") >= F.col("start_line")).withColumn(
        "line_no", F.explode(F.sequence("start_line", "end_line"))
    )
    quoted = spans.join(lines, ["source_id", "line_no"]).groupBy(*key).agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"])).alias("actual")
    )
    bad = (
        F.col("source_id").isNull() | (F.col("end_line") < F.col("start_line")) | (F.col("start_line") < F.col("first_line"))
        | (F.col("end_line") > F.col("last_line")) | is_blank("quote") | ~F.col("actual").eqNullSafe(F.col("quote"))
    )
    found = found.unionByName(flag(anchors.join(quoted, key, "left").filter(bad), "invalid anchor", F.col("fact_id")))
    facts = dataset.anchors.select("fact_id").distinct()
    q = dataset.questions
    checks = [
        ("duplicate question", maintenance.duplicates(q, "query_id"), "query_id"),
        ("duplicate fact", maintenance.duplicates(dataset.anchors.filter("alternative = 0"), "fact_id"), "fact_id"),
        ("duplicate corpus path", maintenance.duplicates(dataset.corpus, "collection_id", "path"), "path"),
        ("duplicate required fact", maintenance.duplicates(dataset.required, "query_id", "fact_id"), "query_id"),
        ("answerability", q.filter(F.col("no_answer") == (F.size("required_facts") > 0)), "query_id"),
        ("unknown required fact", dataset.required.join(facts, "fact_id", "left_anti"), "query_id"),
    ]
    subs = q.filter(F.col("subquestions").isNotNull())
    union = F.flatten(F.col("subquestions.required_facts"))
    checks += [
        ("subquestion fact outside parent", subs.filter(F.size(F.array_except(union, "required_facts")) > 0), "query_id"),
        ("subquestions omit parent fact", subs.filter(F.size(F.array_except("required_facts", union)) > 0), "query_id"),
        ("duplicate subquestion", subs.filter(F.size(F.array_distinct("subquestions.id")) < F.size("subquestions")), "query_id"),
    ]
    for kind, rows, column in checks:
        found = found.unionByName(flag(rows, kind, F.col(column)))
    return found


def budgeted_request(question: dict[str, Any], budget: int, response_limit: int, share: float = 1.0) -> dict[str, Any]:
    """Request whose own JSON plus the largest response stays within ``budget``, the response within ``share`` of what the request leaves.

    The allowance is part of the request text, whose size depends only on how many digits it has: for each number
    of digits the largest allowance is known, and the largest of them counts.
    """
    def with_allowance(n: int) -> dict[str, Any]:
        return {**question, "overrides": {**question.get("overrides", {}), "max_context_chars": n}}

    room = min(int(share * budget), response_limit)
    frame = utf16_units(compact_json(with_allowance(0))) - 1
    digits = range(1, len(str(max(room, 0))) + 1)
    allowance = max((min(room, int(share * (budget - frame - d)), 10**d - 1) for d in digits), default=0)
    if allowance < MIN_CONTEXT_CHARS:
        raise RetrievalError("CONTEXT_BUDGET", f"The question leaves {allowance} of {budget} characters for its response", "Shorten the question")
    parse_request(request := with_allowance(allowance))
    return request


def question_payload(question: dict[str, Any]) -> dict[str, Any]:
    if question.get("subquestions"):
        return {"queries": [{"query_id": s["id"], "text": s["text"]} for s in question["subquestions"]]}
    return {"query": question["query"]}


def returned_pieces(responses: DataFrame) -> DataFrame:
    """Evidence rows of packed responses with their rank."""
    parsed = responses.select("query_id", F.from_json("response", RESPONSE_SCHEMA).alias("r"))
    return parsed.select("query_id", F.posexplode("r.results").alias("i", "e")).select(
        "query_id", (F.col("i") + 1).alias("rank"), "e.*"
    )


def altered_evidence(pieces: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """Returned rows that are not an unchanged prefix of their frozen source lines."""
    wanted = pieces.withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))
    full = wanted.join(lines.withColumnRenamed("text", "line"), ["source_id", "line_no"], "left").groupBy("query_id", "rank").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"])).alias("full"),
        F.count("line").alias("present"),
    )
    joined = pieces.join(full, ["query_id", "rank"]).join(
        sources.select("source_id", F.col("source_version").alias("frozen_version")), "source_id", "left"
    )
    sound = (
        F.col("source_version").eqNullSafe(F.col("frozen_version")) & F.col("full").startswith(F.col("text"))
        & (F.col("present") == F.col("end_line") - F.col("start_line") + 1)
        & (F.col("text_truncated") == (F.length("text") < F.length("full")))
    )
    return joined.filter(~F.coalesce(sound, F.lit(False))).select("query_id", "rank", "chunk_id")


def evaluate_run(
    dataset: EvaluationDataset, responses: DataFrame, requests: DataFrame, sources: DataFrame, lines: DataFrame, reads: DataFrame | None = None
) -> DataFrame:
    """One scored row per question, with what each of its sub-questions asked for and got.

    ``responses``: query_id, status, response, response_chars. ``requests``: query_id,
    request_chars. ``reads``: pieces read besides the results (rank, source_id, lines, text, cost); they follow the results.
    """
    pieces = cut_lineage(returned_pieces(responses))
    broken = altered_evidence(pieces, sources, lines).first()
    if broken:
        raise RetrievalError("INDEX_STALE", f"Returned evidence differs from frozen source: {broken['chunk_id']}")
    anchors = dataset.anchors.join(
        sources.select("source_id", "collection_id", F.col("relative_path").alias("path")), ["collection_id", "path"]
    ).select("fact_id", "source_id", "start_line", "end_line")
    known = pieces
    if reads is not None:
        reads = cut_lineage(reads)
        columns = ("query_id", "rank", "source_id", "start_line", "end_line", "text")
        known = pieces.select(*columns).unionByName(reads.select(*columns[:1], (F.col("rank") + F.lit(1_000_000)).alias("rank"), *columns[2:]))
    ranks = cut_lineage(coverage.line_coverage(known, anchors, lines, dataset.required))
    facts = ranks.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"), metrics.count_if(F.col("rank").isNotNull()).alias("covered"), F.min("rank").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.col("fact_id")))).alias("covered_facts"),
    )
    per_source = pieces.groupBy("query_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    shape = per_source.groupBy("query_id").agg(
        F.sum("n").alias("returned"), F.count(F.lit(1)).alias("distinct_sources"), (F.max("n") / F.sum("n")).alias("max_source_occupancy")
    )
    rows = dataset.questions.select("ord", "query_id", "intent_group", "type", "no_answer")
    asked = dataset.questions.select("query_id", F.posexplode("subquestions").alias("place", "s")).select(
        "query_id", "place", F.col("s.id").alias("id"), F.explode_outer("s.required_facts").alias("fact_id")
    )
    got = asked.join(ranks.select("query_id", "fact_id", "rank"), ["query_id", "fact_id"], "left").groupBy("query_id", "place", "id").agg(
        F.count("fact_id").alias("expected"), F.count("rank").alias("covered")
    )
    parts = got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "expected", "covered"))).alias("parts"))
    parts = parts.select("query_id", F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["expected"].alias("expected"), p["covered"].alias("covered"))).alias("subquestions"))
    read = dataset.questions.select("query_id", F.lit(0).alias("read_chars")) if reads is None else reads.groupBy("query_id").agg(F.sum("cost").alias("read_chars"))
    for side in (facts, shape, responses.select("query_id", "status", "response_chars"), requests, parts, read):
        rows = rows.join(side, "query_id", "left")
    rows = rows.fillna(0, ["read_chars", "expected", "covered", "returned", "distinct_sources", "max_source_occupancy", "response_chars", "request_chars"])
    return rows.withColumns(
        {"rr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), "chars": F.col("request_chars") + F.col("response_chars") + F.col("read_chars")}
    ).drop("first")


def run_evaluation(engine, dataset: EvaluationDataset, sources: DataFrame, lines: DataFrame, budget: int = 20_000) -> DataFrame:
    """Check labels, ask every question within the budget, and score the answers.

    Questions of a frozen dataset are driver-sized; the corpus never leaves the cluster.
    """
    problem = label_problems(dataset, sources, lines).first()
    if problem:
        raise RetrievalError("INVALID_REQUEST", f"{problem['kind']}: {problem['id']}")
    questions = [r.asDict(recursive=True) for r in dataset.questions.orderBy("ord").collect()]
    asked = [budgeted_request(question_payload(q), budget, engine.options.max_context_chars) for q in questions]
    numbers = engine.spark.createDataFrame(
        [(i, q["query_id"], utf16_units(compact_json(r))) for i, (q, r) in enumerate(zip(questions, asked))],
        "request_id long, query_id string, request_chars int",
    )
    packed = cut_lineage(engine.search(asked).join(numbers, "request_id"))
    return evaluate_run(
        dataset, packed.select("query_id", "status", "response", "response_chars"), numbers.select("query_id", "request_chars"), sources, lines
    )


def strategy_grid(lexical_only: bool, default_cap: int) -> list[dict[str, Any]]:
    """Named evaluation strategies with their overrides; ``read`` keeps 35 % for section reading."""
    modes = [("bm25", "bm25")] if lexical_only else [("dense", "dense"), ("hybrid", "hybrid")]
    grid: list[dict[str, Any]] = []
    for name, mode in modes:
        base = {"name": f"{name}_default", "overrides": {"mode": mode, "max_chunks_per_source": default_cap}, "budget_share": 1.0, "subquestions": False}
        grid.append(base)
        if mode == "dense":
            continue
        grid.append({**base, "name": f"{name}_unrestricted", "overrides": {"mode": mode, "max_chunks_per_source": 100}})
        if mode == "hybrid":
            grid.append({**base, "name": "hybrid_subquestions", "subquestions": True})
        grid.append({**base, "name": f"{name}_with_host_read", "budget_share": 0.65})
    return grid


def supplement_sections(pieces: DataFrame, lines: DataFrame, budget: DataFrame) -> DataFrame:
    """Section text read in addition to the results, as whole lines within the budget left: query_id, rank, end_line, cost.

    Sections are read in result order, each once, and each gets what the ones before left of ``budget`` (query_id, room).
    """
    return coverage.host_reads(_read_sections(pieces).join(budget, "query_id"), lines)


def _read_sections(pieces: DataFrame) -> DataFrame:
    """Distinct sections of a query's results in result order, with the cost of asking for one and of its empty piece."""
    # A chunk without section bounds is its own section.
    bounded = pieces.withColumns(
        {f"section_{end}_line": F.coalesce(f"section_{end}_line", f"{end}_line") for end in ("start", "end")}
    )
    sections = bounded.groupBy("query_id", "source_id", "path", "section_start_line", "section_end_line").agg(F.min("rank").alias("rank"))
    request = F.length(
        F.concat(F.lit('{"path":"","start_line":,"end_line":}'), F.col("section_start_line").cast("string"), F.col("section_end_line").cast("string"))
    ) + escape_cost("path")
    frame = F.length(F.concat(F.lit('{"source":"","start_line":,"end_line":,"text":""}'), F.col("section_start_line").cast("string"))) + escape_cost("path")
    return sections.withColumn("fixed", request + frame)


# Share of the budget that a strategy with host reads leaves to the search.
SEARCH_SHARE = 0.65


def run_strategies(
    engine, dataset: EvaluationDataset, sources: DataFrame, lines: DataFrame, budget: int = 20_000, lexical_only: bool = False
) -> DataFrame:
    """Every strategy of the grid over every question: evaluation rows with ``strategy`` and the characters of host reads.

    A strategy with host reads searches within ``SEARCH_SHARE`` of the budget and then reads the sections of its
    results while the rest lasts; what it read counts as evidence. The grid has five strategies at most.
    """
    questions = [r.asDict(recursive=True) for r in dataset.questions.orderBy("ord").collect()]
    out = None
    for strategy in strategy_grid(lexical_only, engine.options.max_chunks_per_source):
        asked = []
        for q in questions:
            payload = question_payload(q if strategy["subquestions"] else {**q, "subquestions": None})
            payload = {**payload, "overrides": strategy["overrides"]}
            asked.append(budgeted_request(payload, budget, engine.options.max_context_chars, strategy["budget_share"]))
        numbers = engine.spark.createDataFrame(
            [(i, q["query_id"], utf16_units(compact_json(r))) for i, (q, r) in enumerate(zip(questions, asked))],
            "request_id long, query_id string, request_chars int",
        )
        packed = cut_lineage(engine.search(asked).join(numbers, "request_id"))
        requests, extra = packed.select("query_id", "request_chars"), None
        if strategy["budget_share"] < 1:
            room = packed.select("query_id", (F.lit(budget) - F.col("request_chars") - F.col("response_chars")).cast("int").alias("room"))
            extra = _read_pieces(returned_pieces(packed), lines, room.filter("room > 0"))
        rows = evaluate_run(dataset, packed.select("query_id", "status", "response", "response_chars"), requests, sources, lines, extra)
        rows = rows.withColumn("strategy", F.lit(strategy["name"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def _read_pieces(pieces: DataFrame, lines: DataFrame, room: DataFrame) -> DataFrame:
    """Pieces of host reads: query_id, rank, source_id, start_line, end_line, text, cost."""
    sections = cut_lineage(_read_sections(pieces).join(room, "query_id"))
    read = coverage.host_reads(sections, lines).join(
        sections.select("query_id", "rank", "source_id", F.col("section_start_line").alias("start_line")), ["query_id", "rank"]
    )
    spans = read.withColumn("line_no", F.explode(F.sequence("start_line", "end_line"))).join(lines, ["source_id", "line_no"])
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]))
    return spans.groupBy("query_id", "rank", "source_id", "start_line", "end_line", "cost").agg(text.alias("text"))


def pair_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of two runs over the same questions; different question sets are refused."""
    keys = ["query_id", "intent_group", "type", "no_answer", "expected"]
    if maintenance.same_rows(baseline.select(*keys), candidate.select(*keys)).first():
        raise RetrievalError("INVALID_REQUEST", "Paired dataset must be identical")
    other = candidate.select("query_id", F.col("covered").alias("c_covered"))
    return baseline.select(
        "query_id", F.col("ord").cast("long").alias("ord"), F.col("intent_group").alias("grp"), "type", "expected",
        F.col("covered").alias("b_covered"),
    ).join(other, "query_id")


def subquestion_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of two runs for each sub-question: sub_id, ord, grp, type, expected and what either run covered.

    Both: query_id, ord, intent_group, type, and ``subquestions``, an array of (id, expected, covered).
    """
    each = lambda run: run.select("query_id", "ord", F.col("intent_group").alias("grp"), "type", F.posexplode("subquestions").alias("place", "s"))
    other = each(candidate).select("query_id", F.col("s.id").alias("sub_id"), F.col("s.covered").alias("c_covered"))
    rows = each(baseline).select(
        "query_id", F.col("s.id").alias("sub_id"), F.col("ord").cast("long").alias("ord"), "grp", "type", F.col("s.expected").alias("expected"), F.col("s.covered").alias("b_covered")
    )
    return rows.join(other, ["query_id", "sub_id"])


def compare_runs(
    baseline: DataFrame, candidate: DataFrame, iterations: int = DEFAULT_ITERATIONS, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Paired bootstrap overall, for each question type and, if the runs have them, for sub-questions: all in one resampling job."""
    pairs = pair_runs(baseline, candidate)
    columns = ("ord", "grp", "expected", "b_covered", "c_covered")
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("type:"), F.col("type")))).alias("scope")
    rows = pairs.select(scopes, *columns)
    if "subquestions" in baseline.columns and "subquestions" in candidate.columns:
        rows = rows.unionByName(subquestion_pairs(baseline, candidate).select(F.lit("subquestions").alias("scope"), *columns))
    return scoped_bootstrap(cut_lineage(rows), iterations, seed)


def piece_cost(piece: dict[str, Any]) -> int:
    """UTF-16 size of a piece's compact JSON without building its escaped text."""
    return utf16_units(json.dumps({**piece, "text": ""}, ensure_ascii=False, separators=(",", ":"))) + escaped_cost(piece["text"])
