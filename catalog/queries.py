"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fixtures as fx
from pairloom.fixed_values import OVERLAP_STOP_WORDS, TECH_KEYWORDS
from pairloom.functions.parse import ground_truth, parse_instruction, split_sections
from pairloom.functions.prompts import student_prompt
from pairloom.functions.scores import cosine
from pairloom.functions.text import (
    clean_text, concat_text, keyword_hits, keyword_overlap, longer_than,
)
from pairloom.operators import clean, evaluate, generate, infer, match, prepare, quality, rank
from pairloom.plans.pairing import create_pairs, job_text
from pairloom.session import new_folder, stored
from pairloom.sources import schemas, tables
from pairloom.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------ clean


@query
def clean_pages(spark, folder):
    kept = F.filter(F.array(clean_text(F.col("html"))), lambda t: longer_than(t, 100))
    return fx.pages(spark, folder).select("page_id", F.explode(kept).alias("text"))


@query
def clean_resumes(spark, folder):
    return clean.clean_left(fx.resumes(spark, folder), min_hits=1)


@query
def clean_jobs(spark, folder):
    return clean.clean_right(fx.jobs(spark, folder), min_hits=1)


@query
def keyword_gate(spark, folder):
    hits = keyword_hits(concat_text(F.col("text"), F.col("source")), TECH_KEYWORDS)
    return fx.documents(spark, folder).select(
        "doc_id", F.explode(F.filter(F.array(hits), lambda n: n >= 1)).alias("hits")
    )


@query
def dedup_first(spark, folder):
    """Over ids of which some are null and some stand for two texts."""
    number = F.col("doc_id")
    odd = F.when(number % 5 == 3, number - 1).when(number % 7 != 2, number)
    docs = fx.documents(spark, folder).select(odd.alias("doc_id"), "text")
    return clean.dedup_keep_first(docs, "text", "doc_id").select(
        "doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5")
    )


@query
def stage_counts(spark, folder):
    left = clean.stage_counts(fx.documents(spark, folder), "text", min_hits=1)
    right = clean.stage_counts(fx.pages(spark, folder), "html", min_hits=1)
    return clean.potential_pairs(left, right)


@query
def head_rows(spark, folder):
    return clean.head(tables.read_table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", 50)


# ------------------------------------------------------------------ match


def _sides(spark, folder):
    left = match.as_documents(fx.resumes(spark, folder), "ID", F.col("Resume_str"))
    right = match.as_documents(fx.jobs(spark, folder), "job_id", job_text())
    return left, right


def _pairs(spark, folder, k, target):
    return create_pairs(fx.resumes(spark, folder), fx.jobs(spark, folder), k, target)


@query
def vocabulary(spark, folder):
    left, right = _sides(spark, folder)
    return match.vocabulary(left.unionByName(right), "text").drop("rank")


@query
def vocabulary_large(spark, folder):
    """Up to 100,000 terms."""
    left, right = _sides(spark, folder)
    return match.vocabulary(left.unionByName(right), "text", max_features=100_000)


@query
def tfidf_topk_large(spark, folder):
    """Best four pages of every document, by up to 100,000 terms."""
    left, right = _sides(spark, folder)
    return match.top_candidates(left, right, match.fit_tfidf(left, right, max_features=100_000), 4)


@query
def tfidf_weights(spark, folder):
    left, right = _sides(spark, folder)
    model = match.fit_tfidf(left, right)
    return model.weights(left, "id", "text").withColumn("weight", F.round("weight", 6))


@query
def tfidf_topk(spark, folder):
    """Best four pages of every document."""
    left, right = _sides(spark, folder)
    model = match.fit_tfidf(left, right)
    return match.top_candidates(left, right, model, 4)


@query
def sample_pairs(spark, folder):
    """The target run: 100 of the best 200 per document until 10,000 pairs."""
    return _pairs(spark, folder, 100, 10000)


@query
def pair_stats(spark, folder):
    stats = match.score_stats(_pairs(spark, folder, 2, None))
    return stats.withColumn("mean_score", F.round("mean_score", 6))


def _enriched(spark, folder, lengths=False):
    pairs = stored(_pairs(spark, folder, 2, None), "pairs", lean=True)
    return match.enrich(pairs, fx.resumes(spark, folder), fx.jobs(spark, folder), lengths)


@query
def enrich_pairs(spark, folder):
    return _enriched(spark, folder)


@query
def dataset_stats(spark, folder):
    return match.dataset_stats(_enriched(spark, folder, lengths=True))


# ------------------------------------------------------------------ generate


@query
def request_lines(spark, folder):
    rows = generate.requests(fx.full_pairs(spark, folder))
    content = F.get("request.contents", F.lit(0))
    return rows.select(
        "key", F.get(content["parts"], F.lit(0))["text"].alias("prompt"), content["role"].alias("role"),
        F.col("request.generation_config.temperature").alias("temperature"),
        F.col("request.generation_config.max_output_tokens").alias("max_output_tokens"),
    )


@query
def request_json(spark, folder):
    """Request lines as JSON text, read back through the declared schema."""
    lines = generate.request_json(generate.requests(fx.full_pairs(spark, folder)))
    back = lines.select(F.from_json("line", schemas.REQUEST).alias("r"))
    content = F.get("r.request.contents", F.lit(0))
    return back.select(
        "r.key", F.md5(F.get(content["parts"], F.lit(0))["text"]).alias("prompt_md5")
    )


def _batched(spark, folder):
    pairs = fx.pair_keys(spark, folder).select("resume_id", "job_id")
    return generate.assign_batches(pairs, ["resume_id", "job_id"])


@query
def batches(spark, folder):
    return _batched(spark, folder).select("resume_id", "job_id", "batch_id")


@query
def pending_batches(spark, folder):
    """Batches that carry the number of a good label are stored already."""
    done = tables.read_table(spark, folder, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("batch_id")
    )
    return generate.pending(_batched(spark, folder), done).select("resume_id", "job_id", "batch_id")


def _outcomes(spark, folder):
    pairs = fx.full_pairs(spark, folder)
    responses = generate.delivered(from_files=fx.response_lines(spark, folder))
    return generate.with_outcome(responses, pairs, order="idx")


@query
def response_outcomes(spark, folder):
    return _outcomes(spark, folder).select("key", "outcome", "tailored_resume", "cover_letter")


@query
def ingest_rows(spark, folder):
    return generate.generated(_outcomes(spark, folder)).drop("timestamp")


@query
def outcome_counts(spark, folder):
    sent = fx.pair_keys(spark, folder).agg(F.count(F.lit(1))).scalar()
    counts = generate.outcome_counts(_outcomes(spark, folder), sent)
    return counts.withColumn("pct_of_sent", F.round("pct_of_sent", 6))


@query
def ingest_summary(spark, folder):
    sent = fx.pair_keys(spark, folder).agg(F.count(F.lit(1))).scalar()
    row = generate.ingest_summary(_outcomes(spark, folder), sent)
    return row.withColumn("success_pct", F.round("success_pct", 6)).withColumn(
        "fail_pct", F.round("fail_pct", 6)
    )


@query
def ingest_stream(spark, folder):
    """The same lines landed as files and taken in by the stream."""
    root = new_folder(spark, "landing")
    fx.response_lines(spark, folder).write.text(f"{root}/in")
    accepted, rejected = f"{root}/accepted", f"{root}/rejected"
    pairs = fx.full_pairs(spark, folder)
    run = ingest(spark, f"{root}/in", pairs, accepted, rejected, f"{root}/checkpoint")
    run.awaitTermination()
    return spark.read.schema(schemas.GENERATED).parquet(f"{accepted}/*").drop("timestamp")


@query
def ingest_rejected(spark, folder):
    """What the stream turned away."""
    root = new_folder(spark, "landing")
    fx.response_lines(spark, folder).write.text(f"{root}/in")
    run = ingest(
        spark, f"{root}/in", fx.full_pairs(spark, folder), f"{root}/accepted", f"{root}/rejected", f"{root}/checkpoint",
        order="idx",
    )
    run.awaitTermination()
    return spark.read.schema("key string, outcome string").parquet(f"{root}/rejected/*")


@query
def ingest_inline(spark, folder):
    """The same responses handed over as a table of keys and records."""
    lines = generate.parse_lines(fx.response_lines(spark, folder))
    inline = lines.filter(~F.col("bad_line")).select("key", "response")
    rows = generate.with_outcome(generate.delivered(inline=inline), fx.full_pairs(spark, folder), order="idx")
    return rows.select("key", "outcome", "tailored_resume", "cover_letter")


@query
def batch_progress(spark, folder):
    outcomes = _outcomes(spark, folder).filter(F.col("outcome") == "ok").select(
        "resume_id", "job_id", F.lit(True).alias("ok")
    )
    joined = _batched(spark, folder).join(outcomes, ["resume_id", "job_id"], "left")
    return generate.batch_progress(joined, kept=F.col("ok").isNotNull())


# ------------------------------------------------------------------ quality


def _labelled(spark, folder):
    return quality.labelled(fx.examples(spark, folder))


@query
def quality_issue(spark, folder):
    return _labelled(spark, folder).select("idx", "issue", quality.issue_kind(F.col("issue")).alias("kind"))


@query
def quality_routing(spark, folder):
    rows = _labelled(spark, folder)
    good = quality.valid(rows).select("idx", F.lit("valid").alias("route"))
    return good.unionByName(quality.invalid(rows).select("idx", F.lit("invalid").alias("route")))


@query
def quality_counts(spark, folder):
    return quality.counts(_labelled(spark, folder)).withColumn(
        "valid_percentage", F.round("valid_percentage", 6)
    )


@query
def issue_histogram(spark, folder):
    return quality.histogram(_labelled(spark, folder))


@query
def top_issues(spark, folder):
    return quality.top_issues(_labelled(spark, folder)).drop("issue_kind")


@query
def first_invalid(spark, folder):
    return quality.first_invalid(_labelled(spark, folder), "idx").select(
        "idx", F.array_join("issues", "|").alias("issues")
    )


@query
def valid_length_stats(spark, folder):
    row = quality.valid_length_stats(_labelled(spark, folder))
    return row.withColumn("resume_mean", F.round("resume_mean", 6)).withColumn(
        "letter_mean", F.round("letter_mean", 6)
    )


def _report_columns(report):
    """A report record flat: counts, reasons as text, the rejected examples as text."""
    reasons = F.array_sort(F.map_entries("failure_reasons"))
    example = lambda e: F.concat_ws(
        ":", e["index"].cast("string"), F.get(e["issues"], F.lit(0)), F.md5(e["example"]["tailored_resume"]))
    return report.select(
        "total_examples", "valid_count", "invalid_count",
        F.round("valid_percentage", 6).alias("valid_percentage"),
        F.array_join(F.transform(reasons, lambda r: F.concat(r["key"], F.lit("="), r["value"].cast("string"))), ";")
        .alias("reasons"),
        F.array_join(F.transform("invalid_examples", example), "|").alias("first_examples"),
    )


@query
def quality_report(spark, folder):
    return _report_columns(quality.report(_labelled(spark, folder), "idx"))


# ------------------------------------------------------------------ prepare


@query
def instruction_records(spark, folder):
    return prepare.training_records(fx.examples(spark, folder), "instruction").select(
        "instruction", "output", "metadata.resume_id", "metadata.job_id", "metadata.similarity_score"
    )


@query
def chat_records(spark, folder):
    rows = prepare.training_records(fx.examples(spark, folder), "chat", keep=("idx",))
    return rows.select("idx", F.posexplode("messages").alias("position", "message")).select(
        "idx", "position", "message.role", "message.content"
    )


@query
def chat_multi_turn(spark, folder):
    """Whole conversations, four turn numbers a record."""
    turns = fx.spread(tables.read_table(spark, folder, "conversations"), "conv_id", "turn")
    rows = prepare.chat_conversations(turns, span=4)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return rows.select(
        "conv_id", "part", F.size("messages").alias("messages"), "answered",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(lines, "\n")).alias("text_md5"),
    )


@query
def chat_text(spark, folder):
    rows = prepare.training_records(fx.examples(spark, folder), "instruction", keep=("idx",))
    return prepare.chat_texts(rows, keep=("idx",))


@query
def split_exact(spark, folder):
    return rank.split_exact(tables.read_table(spark, folder, "documents").select("doc_id"), "doc_id")


@query
def split_counts(spark, folder):
    return prepare.split_counts(split_exact(spark, folder)).withColumn(
        "percentage", F.round("percentage", 6)
    )


@query
def length_stats(spark, folder):
    row = prepare.length_stats(fx.examples(spark, folder))
    for c in ("prompt_mean", "completion_mean", "prompt_tokens", "completion_tokens", "total_tokens"):
        row = row.withColumn(c, F.round(c, 6))
    return row


# ------------------------------------------------------------------ inference text


@query
def student_prompts(spark, folder):
    return fx.examples(spark, folder).select("idx", student_prompt().alias("prompt"))


@query
def sections(spark, folder):
    """Model text and ground truth cut at their markers."""
    rows = prepare.training_records(fx.examples(spark, folder), "instruction", keep=("idx", "cover_letter"))
    cut = F.struct(
        split_sections(F.col("output")).alias("made"), ground_truth(F.col("cover_letter")).alias("truth")
    )
    return rows.select("idx", F.inline(F.array(cut))).select(
        "idx", F.col("made.resume").alias("resume"), F.col("made.letter").alias("letter"),
        F.col("truth.resume").alias("truth_resume"), F.col("truth.letter").alias("truth_letter"),
    )


@query
def instruction_parse(spark, folder):
    rows = prepare.training_records(fx.examples(spark, folder), "instruction", keep=("idx",))
    return rows.select("idx", F.inline(F.array(parse_instruction(F.col("instruction")))))


@query
def inference_results(spark, folder):
    rows = prepare.training_records(fx.examples(spark, folder), "instruction", keep=("idx",))
    inputs = infer.model_inputs(rows, keep=("idx",))
    return infer.results(inputs, "output", keep=("idx",)).select(
        "idx", "resume_id", "job_id", "tailored_resume", "cover_letter",
        "ground_truth_resume", "ground_truth_cover_letter",
    )


# ------------------------------------------------------------------ evaluate


@query
def rouge_n(spark, folder):
    """ROUGE-1 and ROUGE-2 on plain tokens."""
    scores = evaluate.rouge_scores(
        fx.results(spark, folder), "tailored_resume", "ground_truth_resume", ("idx",),
        longest=False, stemmed=False,
    )
    return scores.select("idx", *[F.round(c, 6).alias(c) for c in scores.columns if c != "idx"])


@query
def rouge_l(spark, folder):
    """Stemmed ROUGE-1, -2 and -L."""
    scores = evaluate.rouge_scores(
        fx.results(spark, folder), "tailored_resume", "ground_truth_resume", ("idx",)
    )
    return scores.select("idx", *[F.round(c, 6).alias(c) for c in scores.columns if c != "idx"])


@query
def rouge_l_plain(spark, folder):
    """ROUGE-L on plain tokens."""
    scores = evaluate.rouge_scores(
        fx.results(spark, folder), "tailored_resume", "ground_truth_resume", ("idx",),
        orders=(), stemmed=False,
    )
    return scores.select("idx", *[F.round(c, 6).alias(c) for c in scores.columns if c != "idx"])


@query
def rouge_mean(spark, folder):
    scores = evaluate.rouge_scores(
        fx.results(spark, folder), "tailored_resume", "ground_truth_resume", longest=False, stemmed=False
    )
    row = evaluate.mean_rouge(scores)
    return row.select([F.round(c, 6).alias(c) for c in row.columns])


@query
def bleu_counts(spark, folder):
    return evaluate.bleu_counts(fx.results(spark, folder), "tailored_resume", "ground_truth_resume")


@query
def bleu_score(spark, folder):
    row = evaluate.bleu(bleu_counts(spark, folder))
    return row.select([F.round(c, 6).alias(c) for c in row.columns])


def _vector_pairs(spark, folder):
    """Each vector with the next one."""
    rows = tables.read_table(spark, folder, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference"))
    return rows.select("vec_id", F.col("embedding").alias("prediction")).join(following, "vec_id")


@query
def embedding_cosine(spark, folder):
    return _vector_pairs(spark, folder).select(
        "vec_id", F.round(cosine(F.col("prediction"), F.col("reference")), 6).alias("cosine")
    )


@query
def embedding_similarity(spark, folder):
    row = evaluate.semantic_similarity(_vector_pairs(spark, folder), "prediction", "reference")
    return row.select([F.round(c, 6).alias(c) for c in row.columns])


@query
def keyword_overlap_rows(spark, folder):
    made = F.coalesce("tailored_resume", F.lit(""))
    overlap = keyword_overlap(made, evaluate.target_text(), OVERLAP_STOP_WORDS)
    return fx.results(spark, folder).select("idx", F.round(overlap, 6).alias("overlap"))


@query
def keyword_overlap_stats(spark, folder):
    row = evaluate.overlap_stats(fx.results(spark, folder), "tailored_resume", evaluate.target_text())
    return row.select([F.round(c, 6).alias(c) for c in row.columns])


@query
def text_length_eval(spark, folder):
    row = evaluate.length_stats(fx.results(spark, folder), "tailored_resume")
    return row.withColumn("length_mean", F.round("length_mean", 6)).withColumn(
        "length_std", F.round("length_std", 6)
    )


@query
def token_perplexity(spark, folder):
    losses = tables.read_table(spark, folder, "events").select(
        (F.col("value") / 100).alias("loss"), F.col("user_id").alias("num_tokens")
    )
    return evaluate.perplexity(losses).select(F.round("perplexity", 6).alias("perplexity"))


@query
def ground_truth_gate(spark, folder):
    return evaluate.has_ground_truth(fx.results(spark, folder))


@query
def evaluate_run(spark, folder):
    rows = evaluate.evaluate(fx.results(spark, folder))
    return rows.withColumn("value", F.round("value", 6))


@query
def evaluate_plain(spark, folder):
    """All metrics of the run with unstemmed ROUGE."""
    rows = evaluate.evaluate(fx.results(spark, folder), stemmed=False)
    return rows.withColumn("value", F.round("value", 6))


def _plain_rouge(results):
    scores = evaluate.rouge_scores(
        results, "tailored_resume", "ground_truth_resume", longest=False, stemmed=False
    )
    return evaluate.as_metrics(evaluate.mean_rouge(scores), "rouge_resume")


@query
def compare_runs(spark, folder):
    rows = evaluate.compare(
        _plain_rouge(fx.results(spark, folder)), _plain_rouge(fx.baseline_results(spark, folder))
    )
    return rows.select(
        "metric", *[F.round(c, 6).alias(c) for c in ("fine_tuned", "baseline", "improvement")]
    )


# ------------------------------------------------------------------ sources and sinks


@query
def csv_round_trip(spark, folder):
    path = new_folder(spark, "csv")
    tables.write_csv(clean.clean_left(fx.resumes(spark, folder), min_hits=0, dedup=False), path)
    return tables.read_csv(spark, path, schemas.RESUMES_CLEAN)


@query
def jsonl_round_trip(spark, folder):
    path = new_folder(spark, "jsonl")
    tables.write_jsonl(fx.full_pairs(spark, folder).drop("idx"), path)
    return tables.read_jsonl(spark, path, schemas.FULL_PAIRS)


@query
def json_document_scan(spark, folder):
    """Results stored as JSON arrays and read back as whole documents."""
    path = new_folder(spark, "documents")
    tables.write_json_documents(fx.results(spark, folder), path, "idx", compression="gzip")
    return tables.read_json_document(spark, path, schemas.RESULT).drop("shard")


@query
def split_files(spark, folder):
    path = new_folder(spark, "splits")
    tables.write_splits(split_exact(spark, folder), path)
    return spark.read.schema("doc_id bigint, split string").parquet(path)


@query
def sample_record(spark, folder):
    return tables.sample_record(split_exact(spark, folder), "doc_id")


@query
def request_files(spark, folder):
    path = new_folder(spark, "requests")
    ready = fx.full_pairs(spark, folder, _batched(spark, folder))
    tables.write_batches(generate.requests(ready, keep=("batch_id",)), path)
    stored = spark.read.schema(schemas.REQUEST + ", batch_id bigint").json(path)
    content, config = F.get("request.contents", F.lit(0)), F.col("request.generation_config")
    return stored.select(
        "key", "batch_id", F.get(content["parts"], F.lit(0))["text"].alias("prompt"), content["role"].alias("role"),
        config["temperature"].alias("temperature"), config["max_output_tokens"].alias("max_output_tokens"),
    )


@query
def report_file(spark, folder):
    path = new_folder(spark, "report")
    tables.write_report(quality.report(_labelled(spark, folder), "idx"), path)
    back = spark.read.schema(
        "total_examples bigint, valid_count bigint, invalid_count bigint, valid_percentage double, "
        "failure_reasons map<string, bigint>, invalid_examples array<struct<index: bigint, issues: array<string>, "
        "example: struct<tailored_resume: string>>>"
    ).json(path)
    return _report_columns(back)


METRICS = "map<string, map<string, double>>"


@query
def metrics_report_file(spark, folder):
    """The metrics of a run written as one record and read back as rows."""
    path = new_folder(spark, "metrics")
    rows = evaluate.evaluate(fx.results(spark, folder), stemmed=False)
    tables.write_report(evaluate.metrics_report(rows), path)
    back = spark.read.schema(f"metrics {METRICS}").json(path)
    return (
        back.select(F.explode("metrics").alias("section", "inner"))
        .select("section", F.explode("inner").alias("metric", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query
def compare_report(spark, folder):
    """Two whole runs compared, as one record written and read back."""
    path = new_folder(spark, "comparison")
    runs = [evaluate.evaluate(run(spark, folder), stemmed=False) for run in (fx.results, fx.baseline_results)]
    tables.write_report(evaluate.comparison_report(*[stored(run, "metrics") for run in runs]), path)
    back = spark.read.schema(f"fine_tuned {METRICS}, baseline {METRICS}, improvements map<string, double>").json(path)
    value = lambda side: F.round(F.col(side)["rouge_resume"][F.col("metric")], 6)
    return back.select("fine_tuned", "baseline", F.explode("improvements").alias("metric", "improvement")).select(
        "metric", value("fine_tuned").alias("fine_tuned"), value("baseline").alias("baseline"),
        F.round("improvement", 6).alias("improvement"),
    )


@query
def evaluate_without_truth(spark, folder):
    """Without any reference, lengths and overlaps are all that counts."""
    blank = fx.results(spark, folder).withColumn("ground_truth_resume", F.lit(""))
    return evaluate.evaluate(blank, stemmed=False).withColumn("value", F.round("value", 6))


@query
def evaluate_vectors(spark, folder):
    """The vector part of a run: every result has a vector, the next one is its reference."""
    vectors = tables.read_table(spark, folder, "embeddings")
    n = vectors.agg(F.count(F.lit(1))).scalar()
    results = fx.results(spark, folder).withColumn("vec_id", F.col("resume_id") % n).withColumn(
        "next_id", (F.col("resume_id") + 1) % n)
    made = vectors.select("vec_id", F.col("embedding").alias("made"))
    truth = vectors.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("truth"))
    rows = results.join(made, "vec_id").join(truth, "next_id")
    metrics = evaluate.evaluate(
        rows, {"resume": ("made", "truth"), "cover_letter": ("truth", "made")}, stemmed=False)
    return metrics.filter(F.col("section").startswith("semantic")).withColumn("value", F.round("value", 6))
