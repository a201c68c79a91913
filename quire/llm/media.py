"""Media columns: text bytes as FLAC streams, and FLAC streams as blocks of PCM samples.

`write_flac` stores each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as signed 8-bit mono
samples. `read_flac` decodes stored streams, verifies header, frame and stream checksums and gives the samples back with
the offset of each block; a stream that fails a check has its message in `error` and null samples. `pcm_range` seeks: it
decodes only the frames that hold the samples asked for. `pcm_blocks` gives one row per block with its sample offset.
The query writes the streams to the shared folder, reads them back, and takes the last samples by seeking.

Defined cases: null text is empty (64 zero bytes); equal texts give equal streams; a very long text is one stream, coded a
frame at a time and worked on alone; null media gives null samples and the error `no media`; rows that repeat an id are
worked on each; an empty table stays empty; other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import released, schema_of, stored, table, text_parts, text_slices

PAD = 64
#: Text bytes that one call of the codec gets at most (a longer text goes alone).
AT_ONCE = 3 << 18


def _forget() -> None:
    from quire.llm import flac

    flac.forget()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quire.llm import flac

    for batch in batches:
        keys = batch.column(0)
        for part, raw in text_parts(batch.column(1), AT_ONCE):
            media = flac.encode([t + bytes(-len(t) % PAD if t else PAD) for t in raw])
            sizes = pa.array([len(t) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def write_flac(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media)."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(_write), f"doc_id {kind}, n_bytes long, media binary")


def _feature(pcm) -> str:
    """Level, loudness and sign changes of the samples, rounded."""
    import numpy as np

    x = pcm.astype(np.float64)
    changes = np.count_nonzero(np.diff(np.signbit(x)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};step={np.abs(np.diff(x)).mean():.4f};sign={changes}"


def _decode_each(streams: list) -> list:
    from quire.llm import flac

    try:
        return [(x, blocks, None) for x, blocks in flac.decode(streams)]
    except (flac.FlacError, IndexError, ValueError) as why:
        if len(streams) == 1:
            return [(None, [], str(why)[:200] or "damaged")]
        half = len(streams) // 2
        return _decode_each(streams[:half]) + _decode_each(streams[half:])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32())])
    for batch in batches:
        names, media = batch.schema.names, batch.column(batch.num_columns - 1).to_pylist()
        for part in text_slices([len(m or b"") for m in media], AT_ONCE):
            mine = media[part]
            found = iter(_decode_each([m for m in mine if m is not None]))
            rows = [next(found) if m is not None else (None, [], "no media") for m in mine]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(part.start, len(mine)) for i in range(batch.num_columns)]
                + [
                    pa.array([None if x is None else x.tobytes() for x, _, _ in rows], pa.binary()),
                    pa.array([[{"sample_offset": o, "n_samples": n} for o, n in b] for _, b, _ in rows], pa.list_(block)),
                    pa.array([_feature(x) if x is not None and len(x) > 1 else "" for x, _, _ in rows], pa.string()),
                    pa.array([e for _, _, e in rows], pa.string()),
                ],
                [*names, "pcm", "blocks", "feature", "error"],
            )


def read_flac(media: DataFrame) -> DataFrame:
    """(..., media) -> the same with pcm, blocks (sample_offset, n_samples), feature, error. Samples over 8 bits are little-endian 16-bit."""
    head = [c for c in media.columns if c != "media"]
    shape = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in [*head, "media"])
    return media.select(*head, "media").mapInArrow(released(_read, _forget), f"{shape}, pcm binary, blocks array<struct<sample_offset: bigint, n_samples: int>>, feature string, error string")


def _sought(batches: Iterator[pa.RecordBatch], first: int, count: int) -> Iterator[pa.RecordBatch]:
    from quire.llm import flac

    def one(stream) -> bytes | None:
        try:
            return flac.seek([stream], first, count)[0].tobytes()
        except (flac.FlacError, IndexError, ValueError):
            return None

    for batch in batches:
        media = batch.column(batch.num_columns - 1).to_pylist()
        for part in text_slices([len(m or b"") for m in media], AT_ONCE):
            mine = media[part]
            try:
                found = iter([x.tobytes() for x in flac.seek([m for m in mine if m is not None], first, count)])
                ranges = [None if m is None else next(found) for m in mine]
            except (flac.FlacError, IndexError, ValueError):  # a damaged stream among them: each alone
                ranges = [None if m is None else one(m) for m in mine]
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(part.start, len(mine)) for i in range(batch.num_columns)] + [pa.array(ranges, pa.binary())], [*batch.schema.names, "range"])


def pcm_range(media: DataFrame, first: int, count: int) -> DataFrame:
    """(..., media) -> the same with range: `count` samples from offset `first` (below zero: from the end); null where media is null or damaged there."""
    head = [c for c in media.columns if c != "media"]
    rows = media.select(*head, "media")
    return rows.mapInArrow(released(lambda it: _sought(it, first, count), _forget), schema_of(rows, "range binary"))


def pcm_blocks(read: DataFrame, sample_bytes: int = 1) -> DataFrame:
    """One row per block: doc_id, sample_offset, n_samples, pcm."""
    each = read.select("doc_id", "pcm", F.explode("blocks").alias("b"))
    at = (F.col("b.sample_offset") * sample_bytes + 1).cast("int")
    return each.select("doc_id", F.col("b.sample_offset").alias("sample_offset"), F.col("b.n_samples").alias("n_samples"), F.substr("pcm", at, F.col("b.n_samples") * sample_bytes).alias("pcm"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(write_flac(table(spark, sf_dir, "documents")), "media")
    read = read_flac(pcm_range(media, -PAD, PAD))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32("range").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("n_blocks"),
        "error",
    )
