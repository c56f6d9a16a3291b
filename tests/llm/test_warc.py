import hashlib
import random

import pytest
import zstandard

from edgeloom.llm import warc
from edgeloom.llm.common import workdir

COLUMNS = "page_id long, url string, html string, payload string, digest string, _salt string, keeper string"


def pages():
    r = random.Random(2)
    page = lambda n: "<html>" + "".join(r.choice(["<p>", "</p>", "word ", "déjà ", "\r\n", "WARC/1.1\r\n"]) for _ in range(n)) + "</html>"
    big, exact, small = page(900), "x" * 1000, "x" * 999
    rows = [(i, f"http://h{i % 3}.example/{i}", page(r.randint(1, 400))) for i in range(60)]
    rows += [(100 + i, "http://copy.example/", big) for i in range(30)] + [(200, "u", exact), (201, "u", exact), (202, "u", small), (203, "u", small)]
    rows += [(300, None, None), (301, "bad\r\nX-Evil: 1", ""), (302, "ünï", "é" * 500), (303, "v", "é" * 500), (304, "z", "P*M\x18\x00\x00\x00\x00" * 300)]
    rows += [(None, "n", big), (None, "n2", exact + "!"), (None, "n3", exact + "!"), (129, "again", big), (400, "long", page(60_000))]
    return rows


def expected(rows):
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = best[h] if len(data) >= 1000 and best[h] != -1 and best[h] != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, path = pages(), workdir(spark, "warc")
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], COLUMNS).repartition(4)
    warc.write_archives(df, path, bytes_per_file=60_000)
    got = warc.read_archives(spark, path)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(rows)
    held = {(r.page_id, bytes(r.payload).decode()) for r in got.collect() if r.record_type == "response"}
    assert held <= {(i, h or "") for i, _, h in rows} and {h for _, h in held} == {h or "" for _, _, h in rows}
    assert {r.url for r in got.collect() if r.page_id == 301} == {"bad%0D%0AX-Evil: 1"}


def test_files_are_plain_zstandard(spark):
    path = workdir(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*r, "", "", "", "") for r in pages()], COLUMNS), path, bytes_per_file=60_000)
    files = spark.read.format("binaryFile").load(path + "/*.warc.zst").collect()
    assert len(files) > 1
    for f in files:
        data = bytes(f.content)
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        # any record can be read alone, from its frame's start
        frames = [p for p in range(8 + size, len(data)) if data[p : p + 4] == warc.FRAME_MAGIC and data[p - 8 : p] in (data[p - 8 : p] if p == 8 + size else warc.SEPARATOR.encode(),)]
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[frames[-1] :])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")


def test_damage_is_noticed():
    packed = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "d"))
    assert len(list(warc.records(packed))) == 1
    cut = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "d")[:-6])
    with pytest.raises(ValueError):
        list(warc.records(cut))


def test_empty(spark):
    path = workdir(spark, "warc")
    warc.write_archives(spark.createDataFrame([], COLUMNS), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("most_shared", [0, 10**6])
def test_hot_payloads(spark, most_shared):
    """A third of the pages hold one long payload, a third are empty; with and without the broadcast."""
    big = "<html>" + "shared " * 200
    rows = [(i, f"http://a.example/{i}", (big, "", f"<p>{i} " + "own " * 300)[i % 3]) for i in range(600)] + [(None, "n", big), (7, "again", big), (900, "pair", "pair " * 400), (901, "pair", "pair " * 400)]
    path = workdir(spark, "warc")
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], COLUMNS).repartition(5)
    warc.write_archives(df, path, bytes_per_file=20_000, most_shared=most_shared)
    got = warc.read_archives(spark, path)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(rows)
    sizes = [f.length for f in spark.read.format("binaryFile").load(path + "/*.warc.zst").select("length").collect()]
    assert len(sizes) > 10 and max(sizes) < 60_000


def test_files_under_either_name_are_read(spark):
    path = workdir(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*r, "", "", "", "") for r in pages()], COLUMNS), path, rename=False)
    assert warc.read_archives(spark, path).count() == len(pages())
