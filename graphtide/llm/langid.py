"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A whole text
is lower-cased, its non-letters are folded to one space, and it is compressed with every dictionary in pieces of a fixed size,
each with a fresh dictionary; the smallest sum of results names the language. The score is the margin: the
share by which the best result is smaller than the second best (1 if one language alone was learned). A text is rejected if its
margin is narrow.

Defined results: a null text, and one without a letter, is `und` with score 0 and rejected. Equal sizes go to
the language with the most labelled rows, then to the first by name. Without any learned language every text is
`und`. Repeated rows are judged each by themselves; every piece of a very long text counts. Result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.llm.columns import guarded
from graphtide.runtime import table

#: Labelled rows that are sampled for each language (in the mean; chosen by a hash of the id).
SAMPLE_ROWS = 200
#: Bytes of each language's dictionary, and of the piece that a sampled text gives to it, cut at a place that a hash of the text chooses.
DICTIONARY_BYTES = 48 << 10
PIECE_BYTES = 2 << 10
#: A text is rejected if the second best result is not larger than the best by this share.
MIN_MARGIN = 0.002
LEVEL = 1
#: Bytes of a text that are compressed at once: the gain of a dictionary is bounded, so the margin of one long run would shrink with its length.
CHUNK_BYTES = 16 << 10
#: Sampled pieces that start alike for so many bytes are copies; only the label that most of them have keeps them.
HEAD_BYTES = 48


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, dictionary) for each language of the labelled rows, the most frequent first.

    Bounded: about sample_rows rows for a language are fetched, twice as many at most (where ids repeat), and of each one piece.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = labelled.groupBy(F.col(lang).alias("l")).count().orderBy(F.desc("count"), "l").collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, sample_rows / r["count"]))])
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(F.col(text), F.lit(23)), F.greatest(F.length(text) - PIECE_BYTES, F.lit(0)) + 1).cast("int") + 1
    drawn = labelled.select(F.col(lang).alias("l"), F.col(text).substr(start, F.lit(PIECE_BYTES)).alias("t"), u.alias("u")).filter(F.col("u") < share[F.col("l")])
    w = Window.partitionBy("l").orderBy("u", "t")
    rows = drawn.withColumn("t", folded(F.col("t"))).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 2 * sample_rows).orderBy("l", "k").collect()
    pieces = {r["l"]: list(dict.fromkeys(x["t"].encode()[:PIECE_BYTES] for x in rows if x["l"] == r["l"])) for r in counts}
    pieces = _agreeing(pieces)
    return [(name, b"\n".join(own)[:DICTIONARY_BYTES]) for name, own in pieces.items()]


def folded(text: Column) -> Column:
    """Lower case, and one space for each run of other characters than letters: junk between words would hide the words from the matcher."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def _packers(models: list[tuple[str, bytes]]) -> list:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress for _, content in models]


def _agreeing(pieces: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """Drops sampled pieces whose label the dictionaries of the other half do not confirm: wrong labels in the sample would lend their text to the wrong dictionary."""
    if len(pieces) < 2:
        return pieces
    said = Counter((piece[:HEAD_BYTES], name) for name, own in pieces.items() for piece in own)
    most = {}
    for (head, name), n in said.items():
        most[head] = max(most.get(head, (0, "")), (n, name))
    pieces = {name: [x for x in own if most[x[:HEAD_BYTES]][1] == name] or own for name, own in pieces.items()}
    kept = {name: [] for name in pieces}
    for half in (0, 1):
        models = [(name, b"\n".join(own[half::2])[:DICTIONARY_BYTES]) for name, own in pieces.items()]
        packers = [p if m[1] else None for p, m in zip(_packers(models), models, strict=True)]
        for own, name in enumerate(pieces):
            for piece in pieces[name][1 - half :: 2]:
                sizes = [len(p(piece)) if p else len(piece) for p in packers]
                if sizes[own] == min(sizes):
                    kept[name].append(piece)
    return {name: kept[name] or pieces[name] for name in pieces}


@guarded
def predict(docs: DataFrame, models: list[tuple[str, bytes]], text: str = "text", keep: list[str | Column] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The kept columns (by default all), with lang_pred, score, margin and rejected appended."""
    new = ("lang_pred", "score", "margin", "rejected")
    cols = keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in new]
    base = docs.select(*cols, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"), folded(F.col(text)).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-2])
    names = [m[0] for m in models]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers(shared.value)
        for batch in batches:
            raw = batch.column("__text").cast(pa.binary())
            letter = batch.column("__letter").to_pylist()
            langs, scores, margins, rejected = [], [], [], []
            for i in range(len(raw)):
                if not letter[i] or not packers:
                    langs.append("und"), scores.append(0.0), margins.append(0.0), rejected.append(True)
                    continue
                whole = memoryview(raw[i].as_buffer())
                chunks = [whole[k : k + CHUNK_BYTES] for k in range(0, len(whole), CHUNK_BYTES)]
                sizes = [sum(len(pack(c)) for c in chunks) for pack in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                others = sizes[:best] + sizes[best + 1 :]
                margin = 1 - sizes[best] / min(others) if others else 1.0
                langs.append(names[best]), margins.append(margin), scores.append(min(1.0, margin)), rejected.append(bool(others) and margin < min_margin)
            cols = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[:-2], *new],
            )

    return base.mapInArrow(judge, ", ".join(filter(None, [schema, "lang_pred string, score double, margin double, rejected boolean"])))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.select("doc_id", "text", "lang").filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), models, keep=[F.col("doc_id"), held_out().alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


ORACLE_SQL = None
