from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from pyarrow import fs
from test_packing import library_ids

from trafficlens.llm import tokenfiles, tokens
from trafficlens.llm.tables import fresh_path


class Stream(io.BytesIO):
    fetched = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.fetched += n
        return super().read(n)

    def close(self):
        pass


def test_a_reader_fetches_only_what_it_needs(monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_IDS", 1000)
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 49_000, n).astype("<u4").tobytes()) for i, n in ((None, 5), (3, 0), (7, 2500), (7, 1), (9, 1000), (12, 70_000))]
    stream = Stream()
    writer = tokenfiles.Writer(stream)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = tokenfiles.Reader(stream)
    assert [reader.ids(i) for i in range(len(docs))] == [ids for _, ids in docs]
    assert reader.find(7) == [2, 3] and reader.find(8) == []
    stream.fetched = 0
    reader.ids(4)
    assert stream.fetched < 4200
    # The plain library reads the frames one after the other and skips the rest.
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stream.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(ids for _, ids in docs)
    damaged = bytearray(stream.getvalue())
    damaged[int(reader.starts[-3]) - 6] ^= 255
    with pytest.raises(Exception):
        tokenfiles.Reader(Stream(bytes(damaged))).ids(5)


def test_round_trip(spark, odd_docs, no_docs, small):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(tokenfiles.round_trip(docs).collect(), key=lambda r: r.start)
    at = 0
    for row, ids, r in zip(rows, library_ids([r.text for r in rows]), got, strict=True):
        raw = np.append(ids, [2]).astype("<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert tokenfiles.round_trip(no_docs).count() == 0


def test_files_roll_over(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    folder = fresh_path(spark, "rolled")
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 5000)
    files = tokenfiles.write(docs, folder, tokens.vocabulary())
    assert files.count() > 8 and files.selectExpr("sum(n_docs)").first()[0] == docs.count()
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    assert len(system.get_file_info(fs.FileSelector(root))) == files.count()
    starts = [r.start for r in tokenfiles.read(files, folder).orderBy("doc_id").collect()]
    assert starts == sorted(starts) and len(set(starts)) == docs.count()


def test_words_from_the_model_alone():
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list(tokens.LETTERS), (500, 6)).tolist()] + ["a", "the", "x" * 300]
    encoder = tokens.WordEncoder(tokens.vocabulary())
    found = encoder._by_model(words)
    assert encoder.direct and [found[w] for w in words] == [ids.tobytes() for ids in library_ids(words)]
