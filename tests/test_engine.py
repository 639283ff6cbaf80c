import gzip
import json
import os

import pytest

from hostweave import cli
from hostweave.operators.graph import Metric, Options
from hostweave.plans import report, scan, setup
from hostweave.plans.config import Config
from hostweave.plans.progress import Cancelled, OneJob, Progress
from hostweave.plans.tiers import Store, parse_tiers

HEAD = "#harmonicc_pos\t#harmonicc_val\t#pr_pos\t#pr_val\t#host_rev\t#n_hosts\n"
F1 = {
    "vertices": "0\tcom.aaa\t1\n1\tcom.bbb\t1\n2\torg.ccc\t1\n",
    "edges": "0\t2\n1\t0\n2\t0\n",
    "ranks": HEAD + "1\t900.0\t1\t5.0E-9\tcom.aaa\t1\n2\t800.0\t3\t3.0E-9\tcom.bbb\t1\n3\t700.0\t2\t4.0E-9\torg.ccc\t1\n",
}
F2_NAMES = "com.alpha com.beta com.example com.gamma com.shop net.cdn org.news org.wiki ua.com.demo ua.gov.data".split()
F2_RANKS = [(5, 310, 6, 0.009), (6, 250, 7, 0.0075), (2, 910, 3, 0.044), (8, 120, 9, 0.0032), (4, 430, 4, 0.021), (9, 540, 5, 0.018), (3, 760, 2, 0.052), (1, 980, 1, 0.091), (10, 60, 10, 0.0011), (7, 180, 8, 0.005)]
F2 = {
    "vertices": "".join(f"{i}\t{n}\n" for i, n in enumerate(F2_NAMES)),
    "edges": "".join(e.replace(">", "\t") + "\n" for e in "0>2 0>6 1>2 1>5 2>5 2>6 2>7 3>2 4>2 4>8 6>2 6>7 8>2 8>4 8>9 9>6 2>2 0>2".split()),
    "ranks": HEAD + "".join(f"{a}\t{b}\t{c}\t{d}\t{n}\t1\n" for n, (a, b, c, d) in zip(F2_NAMES, F2_RANKS, strict=True)),
}


def make(tmp_path, body, packed=()):
    out = {}
    for kind, text in body.items():
        path = tmp_path / (f"{kind}.txt.gz" if kind in packed else f"{kind}.txt")
        path.write_bytes(gzip.compress(text.encode()) if kind in packed else text.encode())
        out[kind] = str(path)
    return out


@pytest.fixture(scope="module")
def f1(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("f1")
    store = Store(spark, str(folder / "index"), make(folder, F1))
    assert store.build(["ranks", "inbound"]) == ["lookup", "ranks", "inbound"]
    return store


@pytest.fixture(scope="module")
def f2(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("f2")
    store = Store(spark, str(folder / "index"), make(folder, F2, packed=("ranks", "edges")))
    store.build(["lookup", "ranks", "inbound"])
    return store


def names(entries):
    return [e["domain"] for e in entries]


def test_both_directions_with_ranks(f1):
    r = f1.engine().query("https://www.AAA.com/some/path?x=1")
    assert (r.domain, r.found, r.node_id, r.position, r.inbound_total) == ("aaa.com", True, 0, 1, 2)
    assert r.rank == pytest.approx(5.0e-9, rel=1e-6)
    assert names(r.inbound) == ["ccc.org", "bbb.com"] and names(r.outbound) == ["ccc.org"] and r.warnings == []


def test_missing_domain_and_no_domain(f1):
    r = f1.engine().query("nowhere.example")
    assert not r.found and r.inbound == [] and len(r.warnings) == 1 and "nowhere.example" in r.warnings[0]
    for bad in ("", "  ", "https://", "..."):
        with pytest.raises(ValueError):
            f1.engine().query(bad)


def test_harmonic_changes_value_and_order(f1):
    r = f1.engine().query("aaa.com", Options(metric=Metric.HARMONIC))
    assert (r.rank, r.position, names(r.inbound)) == (900.0, 1, ["bbb.com", "ccc.org"])


def test_result_file(f1, tmp_path):
    path = report.save(f1.engine().query("aaa.com"), str(tmp_path))
    body = json.loads(open(path).read())
    assert os.path.basename(path) == "com.aaa.json" and body["found"] and len(body["inbound"]) == 2 and body["metric"] == "pagerank" and body["inboundTotal"] == 2
    assert report.from_json({"domain": "a.com", "found": True, "rank": 1.0, "inbound": [{"domain": "b.com", "rank": 2.0}]}).inbound[0]["position"] is None


def test_without_inbound_and_ranks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1))
    with pytest.raises(ValueError):
        store.engine().query("aaa.com")
    store.build(["lookup"])
    r = store.engine().query("aaa.com")
    assert r.inbound == [] and r.inbound_total == 0 and r.rank is None and names(r.outbound) == ["ccc.org"] and r.outbound[0]["rank"] == 0.0
    assert any("inbound" in w for w in r.warnings) and any("ranks" in w for w in r.warnings)


@pytest.mark.parametrize(
    "target,metric,rank,position,inbound,outbound",
    [
        ("example.com", "pagerank", 0.044, 3, "news.org shop.com alpha.com beta.com gamma.com demo.com.ua", "wiki.org news.org cdn.net"),
        ("example.com", "harmonic", 910, 2, "news.org shop.com alpha.com beta.com gamma.com demo.com.ua", "wiki.org news.org cdn.net"),
        ("demo.com.ua", "pagerank", 0.0011, 10, "shop.com", "example.com shop.com data.gov.ua"),
        ("demo.com.ua", "harmonic", 60, 10, "shop.com", "example.com shop.com data.gov.ua"),
    ],
)
def test_demo_graph(f2, target, metric, rank, position, inbound, outbound):
    r = f2.engine().query(target, Options(metric=Metric.parse(metric)))
    assert r.rank == pytest.approx(rank, rel=1e-6) and r.position == position
    assert names(r.inbound) == inbound.split() and names(r.outbound) == outbound.split()


def test_cap_is_by_id_before_ranking(f2):
    r = f2.engine().query("example.com", Options(limit=2))
    assert names(r.inbound) == ["alpha.com", "beta.com"] and r.inbound_total == 6 and r.inbound_truncated
    assert r.outbound_total == 2 and r.outbound_degree == 3 and r.outbound_truncated


def test_many_at_once_keep_order_and_first_of_equals(f2):
    reports = f2.engine().query_many(["wiki.org", "http://EXAMPLE.com", "absent.example", "example.com", " "])
    assert [(r.domain, r.found) for r in reports] == [("wiki.org", True), ("example.com", True), ("absent.example", False)]
    assert f2.engine().resolve("wiki.org") == 7 and f2.engine().node_count() == 10


def test_scan_equals_tiers(spark, f2, tmp_path):
    seen = []
    paths = scan.run(spark, f2.sources, ["https://example.com/", "absent.example"], str(tmp_path), progress=Progress(seen.append))
    assert [os.path.basename(p) for p in paths] == ["com.example.json", "example.absent.json"]
    body, stub = (json.loads(open(p).read()) for p in paths)
    r = f2.engine().query("example.com")
    assert names(body["inbound"]) == names(r.inbound) and names(body["outbound"]) == names(r.outbound) and body["rank"] == 0.044 and body["source"] == "scan"
    assert "position" not in body["inbound"][0] and stub == {"domain": "absent.example", "found": False, "rank": None, "inbound": [], "outbound": []}
    assert [u.stage for u in seen if u.done == 0] and seen[-1].stage == "writing"
    assert [u.overall for u in seen] == sorted(u.overall for u in seen) and seen[-1].overall == pytest.approx(1.0)


def test_cancelled_scan_stops(spark, f2, tmp_path):
    progress = Progress()
    progress.cancel()
    with pytest.raises(Cancelled):
        scan.run(spark, f2.sources, ["example.com"], str(tmp_path), progress=progress)


def test_states_and_drop(spark, tmp_path):
    n = 600
    body = {
        "vertices": "".join(f"{i}\tcom.site{i:03}\t1\n" for i in range(n)),
        "edges": "".join(f"{i}\t{(i + 1 + 7 * s) % n}\n" for i in range(n) for s in range(3)),
        "ranks": HEAD + "".join(f"{i + 1}\t1.0\t{i + 1}\t1.0E-9\tcom.site{i:03}\t1\n" for i in range(n)),
    }
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, body))
    assert store.state("lookup") == "missing"
    store.build(list(setup.TIERS))
    status = store.status()
    assert [t.state for t in status.tiers] == ["ready"] * 3 and status.node_count == n and status.edge_count == 3 * n and status.blockers == ()
    assert sorted(e["domain"] for e in store.engine().query("site003.com").inbound) == sorted(f"site{(3 - 1 - 7 * s) % n:03}.com" for s in range(3))
    with open(store.sources["ranks"], "a") as f:
        f.write("601\t1\t601\t1\tcom.other\t1\n")
    assert (store.state("ranks"), store.state("lookup")) == ("stale", "ready")
    store.drop(["inbound"])
    assert (store.state("inbound"), store.state("lookup")) == ("missing", "ready")
    open(os.path.join(store.root, "index.json"), "w").write("{broken")
    assert store.state("lookup") == "missing"


def test_duplicates_self_links_and_hubs(spark, tmp_path):
    body = {
        "vertices": "".join(f"{i}\tcom.n{i:03}\n" for i in range(500)),
        "edges": "".join(f"{i}\t{(i * 13 + s * 29) % 500}\n" for i in range(500) for s in range(7)) + "".join(f"{i}\t{i}\n{i}\t{i * 13 % 500}\n" for i in range(500)),
        "ranks": HEAD,
    }
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, body))
    store.build(["inbound"])
    want = {}
    for i in range(500):
        for s in range(7):
            to = (i * 13 + s * 29) % 500
            if to != i:
                want.setdefault(to, set()).add(i)
    got = {}
    for r in store._tier("inbound", "links").collect():
        got.setdefault(r.to_id, []).append(r.from_id)
    assert got.keys() == want.keys() and all(sorted(got[k]) == sorted(want[k]) for k in want)


def test_unsorted_vertices_answer_with_a_note(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1 | {"vertices": "0\tcom.bbb\n1\tcom.aaa\n2\torg.ccc\n"}))
    store.build(["lookup"])
    assert any("sorted" in w for w in store.engine().query("aaa.com").warnings)
    with pytest.raises(ValueError):
        store.engine(strict=True)


def test_ranks_of_another_release_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1 | {"ranks": HEAD + "1\t1\t1\t1\tnet.other\t1\n"}))
    with pytest.raises(ValueError, match="release"):
        store.build(["ranks"])


def test_space_check(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1))
    monkeypatch.setattr(store, "free", lambda: 1)
    with pytest.raises(OSError, match="space"):
        store.check_space(["lookup", "ranks"])
    monkeypatch.setattr(store, "free", lambda: 0)
    store.check_space(["inbound"])


def test_csv_and_text():
    r = report.Report("x.com", "com.x", True, "pagerank", 1, 5e-9, None, [{"domain": "a.com", "rank": 5e-9, "position": 3}], [{"domain": "b.com", "rank": 2.0, "position": None}], 3, 1)
    assert report.to_csv(r).splitlines() == ["domain,direction,rank,position", "a.com,inbound,0.000000005,3", "b.com,outbound,2,"]
    text = report.as_text(r, top=1)
    assert "5.000000e-09" in text and "… 2 more" in text


def test_parse_tiers_and_metric():
    assert parse_tiers([]) == parse_tiers(["all"]) == ["lookup", "ranks", "inbound"] and parse_tiers(["inbound", "Inbound"]) == ["inbound"]
    with pytest.raises(ValueError, match="lookup"):
        parse_tiers(["backlinks"])
    assert Metric.parse(" PR ") is Metric.PAGERANK and Metric.parse("harmonicc") is Metric.HARMONIC
    with pytest.raises(ValueError):
        Metric.parse("betweenness")


def test_config_round_trip(tmp_path):
    c = Config("C:\\a\\v.txt", "e.txt", "/abs/r.txt", targets=["example.com", 'q"x.com'])
    path = tmp_path / "config.toml"
    c.save(str(path))
    back = Config.load(str(path))
    assert back.targets == c.targets and back.ranks == "/abs/r.txt" and back.edges == str(tmp_path / "e.txt") and back.metric is Metric.PAGERANK
    with pytest.raises(FileNotFoundError, match="edges"):
        (tmp_path / "v").write_text("")
        Config(str(tmp_path / "v"), str(tmp_path / "none"), "r").ensure_files()
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "cc-edges.txt").write_text("")
    path.write_text('[paths]\nvertices = "v"\nedges = "dir"\nranks = "r"\n')
    assert Config.load(str(path)).edges.endswith("cc-edges.txt")


def test_cli(spark, tmp_path, capsys):
    sources = make(tmp_path, F2)
    Config(**sources, results_dir=str(tmp_path / "res"), index_dir=str(tmp_path / "i"), targets=["example.com"]).save(str(tmp_path / "config.toml"))
    base = ["-c", str(tmp_path / "config.toml"), "-q"]
    assert cli.main([*base, "index", "build", "lookup", "ranks"], spark) == 0
    assert cli.main([*base, "query", "example.com", "--json", "--metric", "harmonic", "--save"], spark) == 0
    out = capsys.readouterr().out
    assert '"rank": 910.0' in out and (tmp_path / "res" / "com.example.json").exists()
    assert cli.main([*base, "index", "drop", "ranks"], spark) == 0
    assert cli.main(base, spark) == 0
    assert "com.example.json" in capsys.readouterr().out


def test_one_job_at_a_time():
    jobs, p = OneJob(), Progress()
    jobs.begin(p)
    with pytest.raises(RuntimeError):
        jobs.begin(Progress())
    assert jobs.cancel() and p.cancelled
    jobs.finish()
    assert not jobs.cancel() and not jobs.running


def test_setup_text():
    text = setup.instructions("cc-main-2025-oct", "/data")
    assert all(f"cc-main-2025-oct-domain-{k}.txt.gz" in text for k in ("vertices", "edges", "ranks")) and "/data" in text
    assert [setup.human(n) for n in (0, 1023, 1024, 16 << 30)] == ["0 B", "1023 B", "1 KB", "16.0 GB"]


# ---- what a lookup reads -----------------------------------------------------------------------------------


def test_a_lookup_prunes_by_key(spark, tmp_path, monkeypatch):
    """One domain's links touch few row groups of tables that have many."""
    from hostweave.operators import graph
    from hostweave.plans import engine as E
    from hostweave.plans import tiers

    monkeypatch.setattr(tiers, "ROW_GROUP_BYTES", 1024)
    n = 60_000
    body = {
        "vertices": "".join(f"{i}\tcom.site{i:06}\t1\n" for i in range(n)),
        "edges": "".join(f"{i}\t{(i + s) % n}\n" for i in range(n) for s in (1, 2, 3)),
        "ranks": HEAD + "".join(f"{i + 1}\t1.0\t{i + 1}\t1.0E-9\tcom.site{i:06}\t1\n" for i in range(n)),
    }
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, body))
    store.build(list(setup.TIERS))
    engine = store.engine()
    domains = ["site030000.com", "site000007.com", "absent.com"]
    found, ids = engine._found(domains)
    assert ids == [7, 30000] and engine.query("site030000.com").inbound_total == 3
    links = engine._links(found, ids, 3, Options())
    neighbours = [r.id for r in links.collect()]
    assert len(neighbours) == 12
    reads = {
        "vertices": engine.vertices.filter(E.one_of("rev", ["com.site030000", "com.site000007"])),
        "edges": engine.edges.filter(graph.within("from_id", ids)),
        "inbound": engine.inbound.filter(graph.within("to_id", ids)),
        "names": engine.vertices.filter(graph.within("id", neighbours)),
        "ranks": engine.ranks.filter(graph.within("id", neighbours)),
    }
    for name, df in reads.items():
        whole = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in whole and "PushedFilters: []" not in whole, name
        df._jdf.queryExecution().executedPlan().executeCollect()
        total = {"vertices": n, "names": n, "ranks": n}.get(name, 3 * n)
        df = df.select("*")
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        rows = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
        assert 0 < rows < 0.2 * total, (name, rows)


def test_ranges_hold_all_ids():
    from hostweave.operators import graph

    ids = [5, 1, 2, 3, 900, 901, 50_000, 5]
    assert graph.ranges(ids, 3) == [(1, 5), (900, 901), (50_000, 50_000)] and graph.ranges(ids, 1) == [(1, 50_000)] and graph.ranges([]) == []


def test_scan_shuffles_only_links_of_targets(spark, f2):
    links = scan.scan_links(spark, f2.sources, ["example.com"])[1]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    distinct = [i for i, x in enumerate(lines) if "Aggregate [direction" in x]
    joins = [i for i, x in enumerate(lines) if "Join LeftOuter" in x and ("source" in x or "goal" in x)]
    assert distinct and joins and min(distinct) < min(joins)  # the aggregate lies above the joins with targets


def test_nameless_neighbours_are_counted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1 | {"edges": "0\t2\n0\t77\n1\t0\n88\t0\n"}))
    store.build(["inbound"])
    r = store.engine().query("aaa.com")
    assert names(r.inbound) == ["bbb.com"] and (r.inbound_total, r.outbound_total) == (2, 2)
    assert sum("have no name" in w and w.startswith("1 ") for w in r.warnings) == 2


def test_a_failed_build_leaves_the_old_tier(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "i"), make(tmp_path, F1))
    store.build(["lookup"])
    before = store._folder("lookup")
    with monkeypatch.context() as m:
        m.setattr(store, "save", lambda meta: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store._build_lookup(Progress(), 0.0, 1.0)
    assert store._folder("lookup") == before and names(store.engine().query("aaa.com").outbound) == ["ccc.org"]
    store._build_lookup(Progress(), 0.0, 1.0)
    assert store._folder("lookup") != before and len([x for x in os.listdir(store.root) if x.startswith("lookup-")]) == 1


def test_cancel_interrupts_a_running_job(spark):
    import threading
    import time

    progress = Progress()
    threading.Timer(1.5, progress.cancel).start()
    began = time.monotonic()
    with pytest.raises(Cancelled), progress.jobs(spark):
        spark.range(0, 1 << 36, 1, 4).selectExpr("sum(hash(id, id + 1))").collect()
    assert time.monotonic() - began < 60


def test_sizes_of_this_store_hold_names_and_links():
    whole = setup.SourceSizes(3_430_160_421, 67_065_528_122, 8_331_642_513)
    assert setup.stored_bytes("lookup", whole) > 20 << 30
    assert setup.stored_needed(["lookup"], setup.SourceSizes(100, 100, 100, frozenset({"edges"}))) < 1 << 20
