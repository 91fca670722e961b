"""Operator 9: media columns of baseline JPEG, with DC-only thumbnails."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import jpeg
from logloom.llm.common import Texts, over_texts, row_slices, rows, whole_texts

#: What reading a damaged stream may raise.
DAMAGE = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, jpeg.struct.error)


def decoded(streams: list[bytes]) -> list[tuple[list[jpeg.Image], list[np.ndarray]]]:
    """Images and coefficients of each stream, decoded side by side."""
    images = [list(jpeg.parse(s)) for s in streams]
    blocks = iter(jpeg.coefficients([i for x in images for i in x]))
    return [(x, [next(blocks) for _ in x]) for x in images]


def feature(images: list[jpeg.Image], blocks: list[np.ndarray]) -> str:
    """Width, summed height, number of images and hash of the thumbnail of all, one under the other."""
    grey = [jpeg.thumbnail(i, b) for i, b in zip(images, blocks, strict=True)]
    wide = min(g.shape[1] for g in grey)
    return f"{images[0].width}x{sum(i.height for i in images)}/{len(images)}:{jpeg.average_hash(np.concatenate([g[:, :wide] for g in grey]))}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, padded by 255 to a positive multiple of 576, as quantised coefficients of JPEG."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc_ids, part in texts:
            yield rows(schema, doc_ids, jpeg.store([padded(t.encode("utf-8", "surrogatepass")) for t in part]))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, media binary")


def media_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, thumbnail, thumbnail_hash, problem) of any baseline JPEG, its first image if there are several.

    The thumbnail is a row-major grey byte for each block of the first component, which is read from its own scan or from one with others. A null stream, and one that is no
    baseline JPEG, has nulls and says why in problem.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail", pa.binary()), ("thumbnail_hash", pa.string()), ("problem", pa.string())])

    def first_image(stream: bytes | None) -> jpeg.Image | str:
        if stream is None:
            return "null"
        try:
            return next(jpeg.parse(stream), None) or "no image"
        except DAMAGE as e:
            return str(e)

    def shown(image: jpeg.Image, blocks: np.ndarray) -> tuple:
        grey = jpeg.thumbnail(image, blocks)
        return image.width, image.height, grey.tobytes(), jpeg.average_hash(grey), None

    def alone(image: jpeg.Image) -> tuple:
        try:
            return shown(image, jpeg.coefficients([image])[0])
        except DAMAGE as e:
            return None, None, None, None, str(e)

    def each(images: list[jpeg.Image]) -> list[tuple]:
        """Side by side; where one is damaged, one by one."""
        try:
            return [shown(i, b) for i, b in zip(images, jpeg.coefficients(images), strict=True)]
        except DAMAGE:
            return [alone(i) for i in images]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "media", 1_000_000):
                found = [first_image(x) for x in part.column("media").to_pylist()]
                made = iter(each([x for x in found if not isinstance(x, str)]))
                yield rows(schema, part.column("doc_id"), *zip(*((None, None, None, None, x) if isinstance(x, str) else next(made) for x in found), strict=True))

    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, width int, height int, thumbnail binary, thumbnail_hash string, problem string")


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // jpeg.UNIT)) * jpeg.UNIT - len(data))


def text_media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as ``stored_texts`` does, reads the stored bytes back and returns their digests and feature.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature). A null text counts as empty; its payload is 576
    bytes 255. Equal texts have equal values.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc_ids, part in texts:
            data = [t.encode("utf-8", "surrogatepass") for t in part]
            media = jpeg.store([padded(d) for d in data])
            out = []
            for doc, d, m, (images, blocks) in zip(doc_ids, data, media, decoded(media), strict=True):
                back = jpeg.restore(images, blocks)
                out.append((doc, len(d), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(images, blocks)))
            yield rows(schema, *zip(*out, strict=True))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
