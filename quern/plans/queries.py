"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.checks import token_range_report
from quern.functions import schedule, text as T
from quern.operators import encode, metrics, pack, ranking, replay, select, sequences, vocab
from quern.operators.prefix import with_position
from quern.plans import corpus
from quern.session import new_path, small_batches, stage
from quern.sources import arrays, tables, vocabularies
from quern.streaming import corpus as stream_corpus, metrics as stream_metrics

Query = Callable[[SparkSession, str], DataFrame]

VOCAB_SIZE, MIN_FREQ = 20_000, 2
PIECE_VOCAB, BYTE_VOCAB = 500, 500
SHARD, BLOCK = 10_000, 1_024
SEQ, BATCH, WORLD, ACCUMULATE = 128, 4, 3, 2
RANKS = 4
TRAIN_STEPS = 250
# The step at which the replayed run resumes.
RESUMED = 137
SEED = select.DEFAULT_SEED
# Far below the default, so that small tables, too, take running totals over several levels of nodes.
WINDOW = 64
# Micro-batches of the stream queries.
STREAM_FILES = 8
# Partitions that documents are dealt to; for benches on tables of one split. None leaves them where they lie.
SPREAD: int | None = None

_staged: dict[tuple[str, str, str], object] = {}


def forget_staged() -> None:
    """Let the next query build its inputs anew."""
    _staged.clear()


def _once(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    """Inputs that several queries share are staged once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = build()
    return _staged[key]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_documents(spark, f"{sf}/documents.parquet", partitions=SPREAD)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "cleaned", lambda: stage(corpus.cleaned(_docs(spark, sf)), "cleaned"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "counts", lambda: stage(vocab.word_counts(_cleaned(spark, sf)), "counts"))


def _word_vocab(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: stage(
        vocab.frequent_words_vocab(_counts(spark, sf), VOCAB_SIZE, MIN_FREQ), "vocab"
    )
    return _once(spark, sf, "word_vocab", build)


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return stage(encode.lookup_words(_cleaned(spark, sf), _word_vocab(spark, sf)), "encoded")

    return _once(spark, sf, "encoded", build)


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "shards", lambda: stage(pack.pack_shards(_encoded(spark, sf), SHARD, BLOCK), "shards"))


def _piece_vocab(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return stage(vocab.train_vocab(_counts(spark, sf), PIECE_VOCAB, MIN_FREQ), "vocab")

    return _once(spark, sf, "piece_vocab", build)


# Files of the package of public vocabularies.
PUBLISHED_TOKENIZER = "byte_bpe_50k.json"
PUBLISHED_RANKS = "byte_bpe_50k.tiktoken"
PUBLISHED_MANY = "byte_bpe_multi_50k.tiktoken"


def published_path(name: str) -> str | None:
    """Where the installed package of public vocabularies has a file; None if there is no such package."""
    if importlib.util.find_spec("public_tokenizers") is None:
        return None
    return importlib.import_module("public_tokenizers").path(name) if name else ""


def encode_published(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with a published vocabulary, neighbours merged by the ranks of its file."""
    vocab_, merges = vocabularies.read_tokenizer(spark, published_path(PUBLISHED_TOKENIZER))
    found = encode.encode_bytes(_docs(spark, sf), vocab_, merges=merges)
    return found.select("doc_id", _joined("tokens"), "n_tokens")


def encode_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with a published vocabulary for many languages that lists tokens and ranks only."""
    vocab_ = vocabularies.read_ranks(spark, published_path(PUBLISHED_MANY), {vocab.END_OF_TEXT: 50256})
    return encode.encode_bytes(_docs(spark, sf), vocab_).select("doc_id", _joined("tokens"), "n_tokens")


def _byte_vocab(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: stage(
        vocab.train_byte_vocab(_docs(spark, sf), BYTE_VOCAB, MIN_FREQ), "vocab"
    )
    return _once(spark, sf, "byte_vocab", build)


def _micros(ts: str) -> Column:
    """Microseconds of a time stamp as an integer, whatever the session's zone."""
    day = F.unix_date(F.col(ts).cast("date")) * F.lit(86_400_000_000)
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * F.lit(60_000_000)
    seconds = (F.expr(f"extract(seconds FROM {ts})") * 1_000_000).cast("long")
    return day + minutes + seconds


def _run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a run log: rank, micro-batch number within the rank, loss, seconds."""

    def build() -> DataFrame:
        events = _table(spark, sf, "events").select(
            (F.col("user_id") % RANKS).cast("int").alias("rank"),
            _micros("ts").alias("at"),
            "event_id",
            (F.col("value") / 100).alias("loss"),
            (F.lit(0.1) + (F.col("event_id") % 10) / 100).alias("fb_time"),
        )
        placed = with_position(events, ["at", "event_id"], "batch_idx", ["rank"])
        return stage(placed.select("rank", "batch_idx", "loss", "fb_time"), "run_log")

    return _once(spark, sf, "run_log", build)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accumulated_loss(_run_log(spark, sf), ACCUMULATE)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("int").alias("label"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("token_id", "logit"),
    )


def _score_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("scores")
    )


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ").alias(ids)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; two engines agree on this many digits."""
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def _mapped(f: Callable[[Column], Column]) -> Query:
    return lambda s, sf: small_batches(_docs(s, sf)).select("doc_id", f(F.col("text")).alias("text"))


def _stream_source(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table as a stream of files, in ranges of its key, a range per micro-batch.

    The ranges are written one after the other, as a stream takes files by age.
    Each has as many files as tasks may write at once, filled up with empty ones.
    """

    def build() -> tuple[str, int]:
        rows, out = _table(spark, sf, name), new_path(spark, "arriving")
        files = min(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
        low, high = rows.agg(F.min(key), F.max(key)).first()
        step = (high - low) // STREAM_FILES + 1
        for i in range(STREAM_FILES):
            own = rows.where(F.col(key).between(low + i * step, low + (i + 1) * step - 1))
            (own.repartition(files) if files > 1 else own.coalesce(1)).write.parquet(f"{out}/part={i}")
            for _ in range(files - len(spark.read.schema(rows.schema).parquet(f"{out}/part={i}").inputFiles())):
                rows.limit(0).coalesce(1).write.mode("append").parquet(f"{out}/part={i}")
        return out, files

    path, files = _once(spark, sf, f"arriving-{name}", build)
    rows = tables.stream_documents(spark, f"{path}/*", _table(spark, sf, name).schema, files_per_batch=files)
    return rows


def _batches_run(run) -> None:
    """Wait for a stream to end; it must have run one micro-batch per range."""
    run.awaitTermination()
    if run.lastProgress["batchId"] != STREAM_FILES - 1:
        raise ValueError(f"expected {STREAM_FILES} micro-batches, the last was {run.lastProgress['batchId']}")


def text_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Split documents written as text and read again, one record per line."""
    out = new_path(spark, "text")
    tables.write_text(select.split(_docs(spark, sf), 0.1), out)
    return tables.read_text(spark, {s: [f"{out}/split={s}"] for s in ("train", "validation")})


def shard_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written, and all of them read again, in two ranges."""
    out = new_path(spark, "shards")
    tables.write_shards(pack.pack_shards(_encoded(spark, sf), SHARD, BLOCK, rows_per_window=WINDOW), out)
    both = tables.read_shards(spark, out, last=1).unionByName(tables.read_shards(spark, out, first=2))
    return both.select("shard_id", "block_id", "pos", "n_tokens", _joined("ids"))


def flat_sink(spark: SparkSession, sf: str) -> DataFrame:
    """One uncut stream per split, written and read again."""
    out = new_path(spark, "flat")
    tables.write_shards(pack.flat_stream(select.split(_encoded(spark, sf), 0.1), BLOCK, partition_by=["split"]), out)
    return tables.read_shards(spark, out).select("split", "block_id", "pos", "n_tokens", _joined("ids"))


def array_shard_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written as numbered array files, and all of them read again, in two ranges."""
    out = new_path(spark, "arrays")
    arrays.write_array_shards(_shards(spark, sf), out)
    both = [arrays.read_array_shards(spark, out, BLOCK, last=1), arrays.read_array_shards(spark, out, BLOCK, first=2)]
    return tables.union_sources(*both).select("shard_id", "block_id", "pos", "n_tokens", _joined("ids"))


def flat_file_sink(spark: SparkSession, sf: str) -> DataFrame:
    """One file of ids a split, written in parts, put together and read again by ranges of bytes."""
    out = new_path(spark, "files")
    arrays.write_flat_files(pack.flat_stream(select.split(_encoded(spark, sf), 0.1), BLOCK, partition_by=["split"]), out)
    return arrays.read_flat_files(spark, out, BLOCK, 64).select("split", "block_id", "pos", "n_tokens", _joined("ids"))


def rank_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Batches written with a folder per rank, and each rank's read again."""
    out = new_path(spark, "ranks")
    sequences.write_ranks(sequences.rank_batches(_shards(spark, sf), SEQ, BATCH, WORLD), out)
    read = [sequences.read_rank(spark, out, r) for r in range(WORLD)]
    return _sequences(tables.union_sources(*read), "rank", "step", "row_in_batch", "seq_id")


def replay_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What each rank still reads when its run resumes at a step, over the ends of epochs."""
    out = new_path(spark, "replay")
    replay.write_replay(sequences.rank_batches(_shards(spark, sf), SEQ, BATCH, WORLD), out, ACCUMULATE, 32)
    read = [replay.replay(spark, out, r, RESUMED, TRAIN_STEPS) for r in range(WORLD)]
    return _sequences(tables.union_sources(*read), "rank", "epoch", "global_step", "micro", "row_in_batch", "seq_id")


def text_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of text files written in key order, with their places in the order of the files."""
    out = new_path(spark, "ordered")
    docs = select.split(_docs(spark, sf), 0.1).repartitionByRange(4, "doc_id").sortWithinPartitions("split", "doc_id")
    tables.write_text(docs, out)
    lines = tables.read_text_in_order(spark, {s: [f"{out}/split={s}"] for s in ("train", "validation")})
    return with_position(lines, tables.LINE_ORDER, "place", ["split"], WINDOW).select("split", "place", "line")


def clean_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning called from SQL."""
    T.register_sql(spark)
    _docs(spark, sf).createOrReplaceTempView("quern_clean_docs")
    return spark.sql("SELECT doc_id, clean_text(text) AS text FROM quern_clean_docs")


def _decomposed(c: Column) -> Column:
    """Texts that need NFC: some letters with their accents apart."""
    for whole, apart in DECOMPOSED.items():
        c = F.replace(c, F.lit(whole), F.lit(apart))
    return c


def _padded(c: Column) -> Column:
    """Texts that need stripping, with white space of several kinds at both ends."""
    return F.concat(F.lit(PADDING), c, F.lit(PADDING[::-1]))


def log_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Step records of two halves of a run appended to one table."""
    out = new_path(spark, "log")
    steps = _steps(spark, sf).select("rank", "step", "n")
    for half in ("step % 2 = 0", "step % 2 = 1"):
        tables.append_log(steps.where(half), out)
    return spark.read.parquet(out)


def vocab_sink(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "vocab")
    tables.write_vocab(_word_vocab(spark, sf), out)
    return tables.read_vocab(spark, out)


# What the queries of NFC and stripping put into the texts.
DECOMPOSED = {"é": "e\u0301", "ü": "u\u0308", "ñ": "n\u0303", "a": "a\u0323\u0302"}
PADDING = " \t\x1f\u00a0\n\u2003"


def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "stream")
    docs = _stream_source(spark, sf, "documents", "doc_id").select("doc_id", "text")
    _batches_run(stream_corpus.append_stream(stream_corpus.clean_stream(docs), f"{out}/rows", f"{out}/log"))
    return spark.read.schema("doc_id long, text string").parquet(f"{out}/rows")


def stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "stream")
    docs = stream_corpus.clean_stream(_stream_source(spark, sf, "documents", "doc_id").select("doc_id", "text"))
    encoded = encode.encode_wordpiece(docs, _piece_vocab(spark, sf))
    _batches_run(stream_corpus.pack_stream(encoded, out, f"{out}/log", 100_000, BLOCK))
    return stream_corpus.packed_blocks(spark, out).select(
        "shard_id", "block_id", "n_tokens", _joined("ids")
    )


def _event_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of step records: four events are the records of a step, one of each rank."""
    return _stream_source(spark, sf, "events", "event_id").select(
        (F.col("event_id") % RANKS).cast("int").alias("rank"),
        F.expr(f"event_id div {RANKS}").alias("step"),
        (F.col("value") / 100).alias("batch_loss"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def stream_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Every step once, held back until its group of 125 is complete, the rest at the end."""
    out = new_path(spark, "stream")
    _batches_run(stream_metrics.flush_stream(_event_steps(spark, sf), out, f"{out}/log", 125, RANKS))
    stream_metrics.flush_rest(spark, out, STREAM_FILES - 1, 125)
    return _rounded(stream_metrics.flushed(spark, out), "batch_loss", digits=9)


INTERVAL_SUMS = "interval long, window timestamp, sum double, count long, step long"


def stream_interval_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "stream")
    sums = stream_metrics.interval_sums(_event_steps(spark, sf), 25, "ts", delay="36500 days", width="30 days")
    keys = ["interval", "window"]
    _batches_run(stream_metrics.upsert_stream(sums, f"{out}/rows", f"{out}/log", keys))
    rows = stream_metrics.updates(spark, f"{out}/rows", INTERVAL_SUMS)
    last = stream_metrics.latest_totals(rows, *keys)
    return stream_metrics.interval_totals(last).where("step = (interval + 1) * 25 - 1").select(
        "interval", "step", F.round(F.col("sum") / F.col("count"), 9).alias("train_loss")
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, build a vocabulary, encode, pack, and report the shards."""
    encoded, _ = corpus.word_level(_docs(spark, sf), VOCAB_SIZE, MIN_FREQ)
    return pack.shard_stats(pack.pack_shards(encoded, SHARD, BLOCK))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), "text")


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a manifest of saved files: the model is the event type, the step the event number."""
    path = F.concat(F.lit("out/"), F.col("event_type"), F.lit("-"), F.col("event_id"), F.lit(".pt"))
    return _table(spark, sf, "events").select(F.col("event_type").alias("model"), path.alias("path"))


def _global_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).groupBy("step").agg(F.avg("batch_loss").alias("batch_loss"))


def _sequences(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, _joined("input_ids"), _joined("labels"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.batch_plan(_shards(spark, sf), SEQ, BATCH * WORLD, WORLD, ACCUMULATE)


def all_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    # Sources, splits and order
    q["read_documents"] = _docs
    q["read_lines"] = lambda s, sf: tables.document_lines(_docs(s, sf))
    q["union_sources"] = lambda s, sf: tables.union_sources(
        _docs(s, sf).select(F.lit("documents").alias("origin"), "text"), _conversations(s, sf)
    )
    q["text_sink"] = text_sink
    q["limit_docs"] = lambda s, sf: select.first_n(_table(s, sf, "documents").select("doc_id", "lang", "n_chars"), 300)
    q["split_fraction"] = lambda s, sf: select.split(_table(s, sf, "documents").select("doc_id"), 0.1)
    q["split_count"] = lambda s, sf: select.split(_table(s, sf, "documents").select("doc_id"), 37)
    q["split_counts"] = lambda s, sf: select.split_counts(
        select.split(_table(s, sf, "documents").select("doc_id"), 0.1)
    )
    ids = lambda s, sf: _table(s, sf, "documents").select("doc_id")
    q["shuffle_docs"] = lambda s, sf: select.shuffled_positions(ids(s, sf), rows_per_window=WINDOW)
    q["chunk_ids"] = lambda s, sf: select.chunk_ids(ids(s, sf), 128, rows_per_window=WINDOW)
    q["contiguous_pieces"] = lambda s, sf: select.contiguous_pieces(ids(s, sf), 48, rows_per_window=WINDOW)
    q["rename_split"] = lambda s, sf: select.rename_split(
        ids(s, sf).withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train"))
    )
    q["text_order"] = text_order

    # Text
    q["nfc_text"] = _mapped(lambda c: T.nfc(_decomposed(c)))
    q["clean_charset"] = _mapped(T.clean_charset)
    q["clean_nopunct"] = _mapped(lambda c: T.clean_charset(c, keep_punct=False))
    q["normalize_tone"] = _mapped(T.normalize_tone)
    q["strip_text"] = _mapped(lambda c: T.strip(_padded(c)))
    q["clean_text"] = _mapped(T.clean_text)
    q["clean_sql"] = clean_sql
    q["pretokenize"] = lambda s, sf: _cleaned(s, sf).select(
        "doc_id", F.posexplode(T.pretokenize(F.col("text"))).alias("pos", "word")
    )

    # Vocabularies, encoding, decoding
    q["word_counts"] = lambda s, sf: vocab.word_counts(_cleaned(s, sf), min_freq=3)
    q["word_counts_lower"] = lambda s, sf: vocab.word_counts(_cleaned(s, sf), lowercase=True)
    q["alphabet"] = lambda s, sf: vocab.alphabet(_counts(s, sf))
    q["pair_counts"] = lambda s, sf: vocab.pair_counts(_counts(s, sf))
    q["vocab_table"] = _word_vocab
    q["vocab_sink"] = vocab_sink
    q["vocab_stats"] = lambda s, sf: vocab.vocab_stats(_word_vocab(s, sf))
    q["train_vocab"] = _piece_vocab
    q["train_byte_vocab"] = _byte_vocab
    q["word_level_encode"] = lambda s, sf: encode.encode_words(_cleaned(s, sf), _word_vocab(s, sf), ["doc_id"]).select(
        "doc_id", _joined("tokens"), "n_tokens"
    )
    q["word_lookup"] = lambda s, sf: _encoded(s, sf).select("doc_id", _joined("tokens"), "n_tokens")
    q["append_eot"] = lambda s, sf: _encoded(s, sf).select(
        "doc_id", F.element_at("tokens", -1).alias("last_id"), "n_tokens"
    )
    q["encode_wordpiece"] = lambda s, sf: encode.encode_wordpiece(_cleaned(s, sf), _piece_vocab(s, sf)).select(
        "doc_id", _joined("tokens"), "n_tokens"
    )
    q["encode_bpe"] = lambda s, sf: encode.encode_bytes(_docs(s, sf), _byte_vocab(s, sf)).select(
        "doc_id", _joined("tokens"), "n_tokens"
    )
    if published_path("") is not None:
        q["encode_published"] = encode_published
        q["encode_ranks"] = encode_ranks
    q["keep_text"] = lambda s, sf: encode.encode_wordpiece(_cleaned(s, sf), _piece_vocab(s, sf), keep_text=True).select(
        "doc_id", "text", "n_tokens"
    )
    q["decode_ids"] = lambda s, sf: encode.decode_ids(_encoded(s, sf), _word_vocab(s, sf), ["doc_id"])
    q["decode_bytes"] = lambda s, sf: encode.decode_ids(
        encode.encode_bytes(_docs(s, sf), _byte_vocab(s, sf)), _byte_vocab(s, sf), ["doc_id"], byte_level=True
    )
    q["token_range_report"] = lambda s, sf: token_range_report(_encoded(s, sf))
    q["token_totals"] = lambda s, sf: pack.token_totals(select.split(_encoded(s, sf), 0.1))

    # Token stream
    q["token_offsets"] = lambda s, sf: pack.token_offsets(
        _encoded(s, sf).select("doc_id", "n_tokens"), rows_per_window=WINDOW
    )
    q["pack_shards"] = lambda s, sf: pack.pack_shards(_encoded(s, sf), SHARD, BLOCK, rows_per_window=WINDOW).select(
        "shard_id", "block_id", "pos", "n_tokens", _joined("ids")
    )
    q["shard_sink"] = shard_sink
    q["flat_sink"] = flat_sink
    q["array_shard_sink"] = array_shard_sink
    q["flat_file_sink"] = flat_file_sink
    q["shard_stats"] = flagship
    q["expected_shards"] = lambda s, sf: pack.expected_shards(_encoded(s, sf), SHARD)
    q["flat_stream"] = lambda s, sf: pack.flat_stream(
        select.split(_encoded(s, sf), 0.1), BLOCK, partition_by=["split"]
    ).select("split", "block_id", "pos", "n_tokens", _joined("ids"))
    q["line_stream"] = lambda s, sf: corpus.line_streams(_docs(s, sf), _piece_vocab(s, sf), 0.1, BLOCK).select(
        "split", "block_id", "n_tokens", _joined("ids")
    )
    q["web_shards"] = lambda s, sf: corpus.web_shards(_docs(s, sf), _byte_vocab(s, sf), 100_000, BLOCK).select(
        "shard_id", "block_id", "n_tokens", _joined("ids")
    )
    q["input_label_pairs"] = lambda s, sf: sequences.input_label_pairs(_shards(s, sf))
    q["lm_sequences"] = lambda s, sf: _sequences(sequences.lm_sequences(_shards(s, sf), SEQ), "seq_id")
    q["lm_batches"] = lambda s, sf: _sequences(
        sequences.rank_batches(_shards(s, sf), SEQ, BATCH, wide_ids=True).withColumn("id_type", F.typeof("input_ids")),
        "batch_id",
        "row_in_batch",
        "id_type",
    )
    q["rank_sink"] = rank_sink
    q["rank_batches"] = lambda s, sf: _sequences(
        sequences.rank_batches(_shards(s, sf), SEQ, BATCH, WORLD), "rank", "step", "row_in_batch", "seq_id"
    )
    q["eval_batches"] = lambda s, sf: _sequences(
        sequences.eval_batches(sequences.rank_batches(_shards(s, sf), SEQ, BATCH, WORLD), 20),
        "rank",
        "step",
        "row_in_batch",
    )
    q["batch_plan"] = lambda s, sf: _plan(s, sf).withColumn("opt_step", F.coalesce("opt_step", F.lit(-1)))
    q["epoch_plan"] = lambda s, sf: sequences.epoch_plan(_plan(s, sf), TRAIN_STEPS)

    q["replay_batches"] = replay_batches

    # Run log
    q["weighted_mean"] = lambda s, sf: _rounded(
        _rounded(metrics.weighted_mean(_table(s, sf, "events"), "value", "event_id", ["event_type"]), "average"),
        "sum",
        digits=2,
    )
    q["meter_allreduce"] = lambda s, sf: _rounded(
        metrics.meter_allreduce(metrics.rank_meters(_run_log(s, sf))), "sum", "average", digits=9
    )
    q["meter_allreduce_scaled"] = lambda s, sf: _rounded(
        metrics.meter_allreduce_scaled(metrics.rank_meters(_run_log(s, sf)), RANKS), "sum", "count", "average", digits=9
    )
    q["meter_gather"] = lambda s, sf: _rounded(
        metrics.meter_gather(metrics.rank_meters(_run_log(s, sf)))
        .select("name", F.posexplode("gathered").alias("place", "m"))
        .select("name", "place", "m.rank", "m.sum", "m.count"),
        "sum",
        digits=9,
    )
    q["accumulated_loss"] = lambda s, sf: _rounded(_steps(s, sf), "batch_loss", "fb_time", digits=9)
    q["log_sink"] = log_sink
    q["step_loss"] = lambda s, sf: _rounded(metrics.step_loss(_steps(s, sf)), "batch_loss", digits=9)
    q["throughput"] = lambda s, sf: _rounded(
        metrics.throughput(_steps(s, sf), BATCH * ACCUMULATE * SEQ, RANKS), "throughput"
    )
    q["interval_loss"] = lambda s, sf: _rounded(metrics.interval_loss(_steps(s, sf), 50), "train_loss", digits=9)
    q["eval_loss"] = lambda s, sf: _rounded(metrics.eval_loss(_run_log(s, sf), 100), "loss", "perplexity", digits=9)
    q["perplexity"] = lambda s, sf: _rounded(
        metrics.perplexity(
            metrics.weighted_mean(_run_log(s, sf), "loss", by=["rank"]).select("rank", F.col("average").alias("loss"))
        ),
        "loss",
        "perplexity",
        digits=9,
    )
    q["cross_entropy"] = lambda s, sf: _rounded(metrics.cross_entropy_arrays(_score_arrays(s, sf)), "loss", digits=9)
    q["cross_entropy_rows"] = lambda s, sf: _rounded(metrics.cross_entropy(_scores(s, sf)), "loss", digits=9)

    # Schedules
    q["lr_noam"] = lambda s, sf: _global_steps(s, sf).select(
        "step", F.round(schedule.noam_decay(F.col("step"), 768, 400) * 1000, 6).alias("rate")
    )
    q["lr_cosine"] = lambda s, sf: _global_steps(s, sf).select(
        "step", F.round(schedule.cosine_decay(F.col("step"), 0.6, 0.06, 100, 900), 6).alias("rate")
    )
    q["step_log"] = lambda s, sf: _rounded(
        schedule.step_log(
            _rounded(_global_steps(s, sf), "batch_loss", digits=9),
            schedule.cosine_decay(F.col("step"), 0.6, 0.06, 100, 900, factor=1 / 0.6),
            0.6,
        ),
        "learning_rate",
    )

    # Score tables
    keys = ["row_id", "token_id"]
    tenths = lambda: F.transform("scores", lambda x: F.round(x.cast("double"), 1))
    q["topk_ties"] = lambda s, sf: ranking.score_rows(
        _score_arrays(s, sf), ranking.top_k_array(ranking.score_array(tenths()), 5), "row_id"
    )
    q["softmax_rows"] = lambda s, sf: _rounded(
        ranking.score_rows(
            _score_arrays(s, sf), ranking.softmax_array(ranking.score_array(F.col("scores"), 0.7)), "row_id"
        ).select(*keys, "prob"),
        "prob",
    )
    q["nucleus_array"] = lambda s, sf: ranking.score_rows(
        _score_arrays(s, sf), ranking.top_p_array(ranking.score_array(F.col("scores")), 0.5), "row_id"
    ).select(*keys)
    q["cumulative_mass"] = lambda s, sf: _rounded(
        ranking.cumulative_mass(_scores(s, sf)).select(*keys, "cum_prob"), "cum_prob"
    )
    q["nucleus"] = lambda s, sf: ranking.top_p(_scores(s, sf), 0.5).select(*keys)
    q["decode_filter"] = lambda s, sf: _rounded(
        ranking.score_rows(
            _score_arrays(s, sf), ranking.decode_filter_array(F.col("scores"), 0.7, 20, 0.8), "row_id"
        ).select(*keys, "prob"),
        "prob",
    )
    q["decode_filter_rows"] = lambda s, sf: _rounded(
        ranking.decode_filter(_scores(s, sf), 0.7, 20, 0.8).select(*keys, "prob"), "prob"
    )
    q["sample_token"] = lambda s, sf: ranking.sample_token(ranking.softmax_rows(_scores(s, sf)), SEED)
    q["retain_latest"] = lambda s, sf: ranking.retain_latest(_checkpoints(s, sf), 5)

    # Streams
    q["stream_clean"] = stream_clean
    q["stream_pack"] = stream_pack
    q["stream_metrics"] = stream_flush
    q["stream_interval_loss"] = stream_interval_loss
    return q
