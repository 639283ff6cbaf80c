import gzip

import pytest

from hostweave.operators import quality
from hostweave.sources import text


def write(path, body):
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(path)


def ids(df):
    return sorted((r.id, r.rev) for r in df.select("id", "rev").collect())


def test_vertices_are_parsed_permissively(spark, tmp_path):
    body = b"# head\n0\tcom.a\t3\r\n+5\tx\n 5\tx\n4294967295\ta\n4294967296\tb\n7\t\n\n12x\tc\n8\tq\"uo\rte\n9\xff\tbad\n10\t\xffbad\n# mid\n11\tlast"
    assert ids(text.read_vertices(spark, write(tmp_path / "v.txt", body))) == [(0, "com.a"), (8, 'q"uo\rte'), (11, "last"), (4294967295, "a")]


def test_edges_take_leading_digits_of_the_second_field(spark, tmp_path):
    path = write(tmp_path / "e.txt", "1\t5abc\n1\t5\t9\n2\tx\n+1\t2\n3\t4294967296\n# 1\t2\n4\t6\r\n5\t7")
    rows = sorted((r.from_id, r.to_id) for r in text.read_edges(spark, path).collect())
    assert rows == [(1, 5), (1, 5), (4, 6), (5, 7)]


def test_ranks_header_may_reorder_columns():
    at = text.RankLayout.from_header("#host_rev\t#pr_val\t#harmonicc_val")
    assert (at.rev, at.pagerank, at.harmonic) == (0, 1, 2)


@pytest.mark.parametrize("packed", [False, True])
def test_ranks(spark, tmp_path, packed):
    body = "#harmonicc_pos\t#harmonicc_val\t#pr_pos\t#pr_val\t#host_rev\t#n_hosts\n1\t9.5E2\t2\t5.0E-9\tcom.a\t1\n2\tnan\tx\tinf\tcom.b\t1\nshort\t1\n3\t1\t3\t1\t\t1\n4\t7\t4\t8\tcom.a\t1\n"
    path = tmp_path / ("r.txt.gz" if packed else "r.txt")
    path.write_bytes(gzip.compress(body.encode()) if packed else body.encode())
    rows = {r.rev: r for r in text.read_ranks(spark, str(path)).collect()}
    assert set(rows) == {"com.a", "com.b"}
    assert (rows["com.a"].harmonic, rows["com.a"].pagerank, rows["com.a"].harmonic_position) == (7.0, 8.0, 4)  # the last line wins
    assert (rows["com.b"].harmonic, rows["com.b"].pagerank, rows["com.b"].pagerank_position) == (0.0, float("inf"), 0)


def test_order_flags(spark, tmp_path):
    path = write(tmp_path / "v.txt", "0\tcom.b\n1\tcom.a\n2\tcom.c\n")
    s = quality.summarize_vertices(text.read_vertices(spark, path))
    assert (s.node_count, s.node_capacity, s.sorted_by_name, s.sorted_by_id) == (3, 3, False, True)


def test_every_line_is_seen_once(spark, tmp_path):
    body = "\n".join(f"{i}\tcom.{'x' * (i % 97)}s{i:05}" for i in range(5000))
    df = text.read_vertices(spark, write(tmp_path / "v.txt", body))
    assert df.count() == 5000 and df.select("id").distinct().count() == 5000


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "v.txt", "")
    assert quality.summarize_vertices(text.read_vertices(spark, path)).node_count == 0
    assert text.read_ranks(spark, path).count() == 0


def test_crawl_of():
    assert text.crawl_of("/x/cc-main-2025-oct-nov-dec-domain-edges.txt") == "cc-main-2025-oct-nov-dec"
    assert text.crawl_of("edges.txt") is None and text.crawl_of("my-own-domain-edges.txt") is None


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("broken", [None, 0, 1700])
def test_order_of_plain_and_packed_files(spark, tmp_path, packed, broken, monkeypatch):
    monkeypatch.setattr(quality, "STRETCH", 500)  # several stretches, and breaks within and between them
    rows = [f"{i}\tcom.s{i:06}" for i in range(3000)]
    if broken is not None:
        rows[broken], rows[broken + 1] = rows[broken + 1], rows[broken]
    body = "\n".join(rows).encode()
    path = write(tmp_path / ("v.txt.gz" if packed else "v.txt"), gzip.compress(body) if packed else body)
    s = quality.summarize_vertices(text.read_vertices(spark, path))
    assert (s.node_count, s.sorted_by_name, s.sorted_by_id) == (3000, broken is None, broken is None)


def test_breaks_between_far_stretches_are_seen(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "STRETCH", 10)
    place = F.struct(F.lit("f").alias("file_path"), F.lit(0).alias("file_block_start"), F.col("line"))
    df = spark.createDataFrame([(0, 5), (1, 6), (950, 6), (5000, 7), (5001, 1)], "line bigint, v int").withColumn("place", place)
    assert tuple(quality.order_breaks(df, ["v"]).first()) == (5, 2)
    assert tuple(quality.order_breaks(df.limit(0), ["v"]).first()) == (0, 0)
