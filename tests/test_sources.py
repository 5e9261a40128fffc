import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import stats
from lexigrid.schema import PAPER
from lexigrid.sources import corpus, records, release
from lexigrid.streaming import ingest


def test_pmlr(spark):
    listing = '<div class="paper">\n<p class="title">A &amp; <i>B</i></p> <span class="authors">X Y,&nbsp;Z</span> [<a href="https://p/v1/a20.html">abs</a>]</div>' * 1 + '<div class="paper"><p class="title">C</p><span class="authors">Q</span>[<a href="https://p/v1/c21.html">abs</a>]'
    pages = spark.createDataFrame([(2020, listing)], "year int, html string")
    own = spark.createDataFrame([("a20", '<div id="abstract" class="x">One\n two &lt;3</div><a href="https://p/a20.pdf">')], "slug string, html string")
    got = {r.source_id: r for r in records.pmlr_papers(records.pmlr_listing(pages), own).collect()}
    assert got["a20"].title == "A & B" and got["a20"].abstract == "One two <3" and got["a20"].pdf_url == "https://p/a20.pdf"
    assert [a.name for a in got["a20"].authors] == ["X Y", "Z"] and got["c21"].abstract == "" and got["c21"].paper_id == "icml:2020:c21"


def test_neurips(spark):
    entry = '<li class="c" data-track="%s"> <a title="t" href="/paper_files/paper/2022/hash/%s-Abstract.html">T %s</a> <span class="paper-authors">A, B</span></li>'
    pages = spark.createDataFrame([(2022, entry % ("conference", "ab1", 1) + entry % ("datasets", "ab2", 2))], "year int, html string")
    assert [r.hash for r in records.neurips_listing(pages).collect()] == ["ab1"] and records.neurips_listing(pages, main_only=False).count() == 2
    nested = '<p class="paper-abstract"><p>In</p> <div>Name Change Policy</div></p></div>'
    own = spark.createDataFrame([("ab1", nested)], "hash string, html string")
    assert records.neurips_papers(records.neurips_listing(pages), own).first().abstract == "In"
    plain = spark.createDataFrame([('<p class="paper-abstract">Plain</p></section>',)], "html string")
    assert plain.select(records.neurips_abstract(F.col("html"))).first()[0] == "Plain"
    side = spark.createDataFrame([(2025, entry % ("creative", "cd", 1) + '<a href="/paper_files/paper/2025/vol38-main">')], "year int, html string")
    assert records.main_volume(side.unionByName(pages)).collect()[0].volume == "/paper_files/paper/2025/vol38-main"


def test_openreview_both_forms(spark):
    old = {"id": "n1", "content": {"title": " A  title", "abstract": "x", "authors": ["P", "Q"], "authorids": ["~P1", "q@x.org"], "keywords": []}}
    new = {"id": "n2", "content": {"title": {"value": "B"}, "abstract": {"value": None}, "authors": {"value": ["R"]}, "authorids": {"value": []}, "keywords": {"value": ["k"]}, "primary_area": {"value": "z"}}}
    df = spark.createDataFrame([(2024, json.dumps({"notes": [old, new]}))], "year int, json string")
    got = {r.source_id: r for r in records.openreview_papers(df).collect()}
    assert got["n1"].title == "A title" and [a.source_author_id for a in got["n1"].authors] == ["~P1", None] and got["n1"].keywords is None
    assert got["n2"].title == "B" and got["n2"].abstract == "" and got["n2"].keywords == ["k"] and got["n2"].primary_area == "z" and got["n2"].authors[0].source_author_id is None


def test_anthology_and_index(spark):
    xml = """<collection id="2020.x"><volume id="main"><meta/><paper id="0"><title>Front</title><pages>i-x</pages></paper>
    <paper id="1"><title>A <fixed-case>B</fixed-case> c</title><author id="j-d"><first>J</first><last>D</last></author><author><last>Solo</last></author>
    <abstract>T &amp; u</abstract><pages>1–9</pages><url>2020.x-main.1</url><doi>10/1</doi></paper></volume><volume id="demo"><paper id="1"><title>No</title><pages>1</pages></paper></volume></collection>"""
    df = spark.createDataFrame([("acl", 2020, "2020.x", ["main"], xml)], "venue string, year int, collection string, main_volumes array<string>, xml string")
    (p,) = records.anthology_papers(df).collect()
    assert p.title == "A B c" and p.abstract == "T & u" and [(a.name, a.source_author_id) for a in p.authors] == [("J D", "j-d"), ("Solo", None)] and p.paper_id == "acl:2020:2020.x-main.1"
    dblp = spark.createDataFrame([("acl", 2020, "<r><proceedings><title>P</title></proceedings><inproceedings><title>A <i>B</i> c.</title></inproceedings></r>")], "venue string, year int, xml string")
    assert [r.key for r in records.dblp_titles(dblp).collect()] == ["a b c"]


def test_xml_asides(spark):
    cases = {
        "<t><![CDATA[a < b & </t>]]></t>": "<t>a &lt; b &amp; &lt;/t&gt;</t>",
        "<t>x<!-- </t> <![CDATA[ -->y</t>": "<t>xy</t>",
        "<?xml version='1.0'?><t><![CDATA[<!-- kept -->]]><![CDATA[]]>z</t>": "<t>&lt;!-- kept --&gt;z</t>",
        "<t>none</t>": "<t>none</t>", "": "", None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "xml string, want string")
    assert [(r.got, r.want) for r in df.select(records.plain_xml(F.col("xml")).alias("got"), "want").collect() if r.got != r.want] == []
    long = spark.range(1).select(F.concat(F.lit("<t><!--"), F.repeat(F.lit("x "), 200_000), F.lit("-->k</t>")).alias("xml"))
    assert long.select(records.plain_xml(F.col("xml"))).first()[0] == "<t>k</t>"


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.675,), (None,)], "x double")
    assert [r[0] for r in df.select(stats.half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, 0.0, 3.0, None]
    assert [r[0] for r in df.select(stats.half_even(F.col("x"), 2)).collect()][:5] == [float(v) for v in np.round([0.5, 1.5, 2.5, -0.5, 2.675], 2)]


def test_partitioned_write_and_scan(spark, tmp_path):
    papers = records.as_papers(spark.createDataFrame([("a:1:x", "a", 1), ("b:2:y", "b", 2)], "paper_id string, venue string, year int"))
    root = str(tmp_path / "n")
    corpus.write_partitioned(papers, root)
    corpus.write_partitioned(papers.filter("venue = 'a'").withColumn("title", F.lit("new")), root)
    back = spark.read.parquet(root)
    assert {(r.paper_id, r.title) for r in back.collect()} == {("a:1:x", "new"), ("b:2:y", None)}
    assert {f.name for f in PAPER.fields} == set(back.columns)
    with pytest.raises(ValueError, match="duplicate"):
        twice = str(tmp_path / "t")
        papers.union(papers).select("paper_id", "title").write.parquet(twice)
        corpus.scan_unique(spark, twice)


def test_stores(spark, tmp_path):
    np.savez(tmp_path / "s.npz", ids=np.array(["a", "b"]), vecs=np.eye(2, dtype=np.float32))
    df = corpus.import_store(spark, str(tmp_path / "s.npz"))
    assert {r.paper_id: r.vec for r in df.collect()} == {"a": [1, 0], "b": [0, 1]}
    corpus.export_store(df, str(tmp_path / "t.npz"))
    with np.load(tmp_path / "t.npz") as z:
        assert z["ids"].tolist() == ["a", "b"]
    assert [r.paper_id for r in corpus.without_prefix(df, "a").collect()] == ["b"]
    np.savez(tmp_path / "bad.npz", ids=np.array(["a", "a"]), labels=np.array([1, 2]))
    with pytest.raises(ValueError):
        corpus.import_store(spark, str(tmp_path / "bad.npz"), "labels")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    store = str(tmp_path / "v")
    assert corpus.resume(docs.filter("doc_id = 1"), store, lambda t: [[1.0, 1.0]] * len(t)).count() == 1
    assert corpus.resume(docs, store, lambda t: [[2.0, 0.0]] * len(t)).count() == 2


def test_labels_and_config(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"7": {"label": "D", "size": 2, "keywords": ["k"], "sample_titles": ["t"]}, "8": {"label": "O", "size": 1}}))
    df = corpus.read_labels(spark, str(tmp_path / "l.json"))
    assert {r.cluster_id: r.label for r in df.collect()} == {7: "D", 8: "O"}
    corpus.write_labels(df, str(tmp_path / "out"))
    assert corpus.read_labels(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "c.toml").write_text('[[collection]]\nvenue="acl"\nyear=2020\nmain_volumes=["main"]\nexpected=3\n')
    assert corpus.read_config(spark, str(tmp_path / "c.toml")).first().expected == 3


def test_raw_cache(spark, tmp_path):
    root = str(tmp_path)
    corpus.cache_write(root, "pmlr", "icml", 2020, "listing", "html", b"<p>")
    path = corpus.cache_write(root, "pmlr", "icml", 2020, "x", "html", b"abc", {"url": "u"})
    path.with_name("lonely.html").write_bytes(b"no sidecar")
    got = corpus.raw_cache(spark, root)
    assert {(r.source, r.venue, r.year, r.part, r.bytes) for r in got.collect()} == {("pmlr", "icml", "2020", "listing", 3), ("pmlr", "icml", "2020", "x", 3)}
    assert corpus.cache_faults(got).count() == 0
    path.write_bytes(b"abd")
    assert corpus.cache_faults(corpus.raw_cache(spark, root)).count() == 1


def test_release(spark, tmp_path):
    base = tmp_path / "data"
    (base / "n").mkdir(parents=True)
    (base / "n" / "a.bin").write_bytes(b"1")
    (base / "b.json").write_text("{}")
    one = release.build(spark, str(base), str(tmp_path / "o1"), "2024.1", 4)
    two = release.build(spark, str(base), str(tmp_path / "o2"), "2024.1", 4)
    assert one.read_bytes() == two.read_bytes()
    assert [f["path"] for f in release.verify(spark, one)["files"]] == ["b.json", "n/a.bin"]
    changed = release.build(spark, str(base), str(tmp_path / "o3"), "2024.2", 4)
    changed.write_bytes(one.read_bytes())
    with pytest.raises(ValueError, match="published hash"):
        release.verify(spark, changed)
    release.hash_file(changed).write_text(release._hash_line(changed))
    found = {(r.path.partition(":")[0], r.fault) for r in release.faults(spark, changed).collect()}
    assert found == {("manifest.json", "format or version"), ("not a file of this release", "unexpected")}
    import io
    import tarfile

    with tarfile.open(one) as old, tarfile.open(two, "w:gz") as new:
        for m in old:
            data = old.extractfile(m).read()
            data, m.size = (b"[]", 2) if m.name.endswith("b.json") else (data, m.size)
            new.addfile(m, io.BytesIO(data))
        for name in ("extra", "extra"):
            info = tarfile.TarInfo(f"{one.name.removesuffix('.tar.gz')}/{name}")
            new.addfile(info, io.BytesIO(b""))
    release.hash_file(two).write_text(release._hash_line(two))
    assert {(r.path, r.fault) for r in release.faults(spark, two).collect()} == {("b.json", "hash"), ("extra", "unexpected"), ("extra", "repeated")}
    for bad in ("", "V1", "a/b"):
        with pytest.raises(ValueError):
            release.check_version(bad)
    (base / "n" / "a.bin").write_bytes(b"2")
    (base / "c").write_text("new")
    assert {(r.path, r.fault) for r in release.differences(spark.createDataFrame([("b.json", 2, "0"), ("gone", 1, "0")], "path string, bytes long, sha256 string"), release.checksums(spark, str(base))).collect()} == {("b.json", "hash"), ("gone", "missing"), ("n/a.bin", "unexpected"), ("c", "unexpected")}


def test_landing_stream(spark, tmp_path):
    schema = "paper_id string, venue string, ts timestamp"
    source = str(tmp_path / "in")
    rows = spark.sql("SELECT * FROM VALUES ('a', 'x', timestamp'2024-01-01 00:00:00'), ('a', 'x', timestamp'2024-01-01 01:00:00'), ('b', 'y', timestamp'2024-01-02 00:00:00') AS t(paper_id, venue, ts)")
    rows.write.parquet(source)
    stream = ingest.once(ingest.landing(spark, source, rows.schema))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.write(stream, out, state).awaitTermination()
    assert spark.read.schema(schema).parquet(out).count() == 2
    rows.write.mode("append").parquet(source)
    ingest.write(ingest.once(ingest.landing(spark, source, rows.schema)), out, state).awaitTermination()
    assert spark.read.schema(schema).parquet(out).count() == 2
    counted = ingest.counts(ingest.landing(spark, source, rows.schema), "venue")
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.venue, r.n) for r in spark.table("counts").collect()} == {("x", 4), ("y", 2)}


def test_hash_of_a_large_file_by_steps(spark, tmp_path):
    import hashlib

    noise = np.random.default_rng(0).integers(0, 256, 5000, np.uint8).tobytes()
    contents = {
        "noise": noise, "ends.parquet": noise + b"\n", "two [ends]": noise + b"\n\n", "mark": b"\xef\xbb\xbf" + noise, "mark_ends": b"\xef\xbb\xbf" + noise + b"\n",
        "feeds": b"\n" * 3000, "returns": b"a\r\nb\rc" * 500, "one_line": b"x" * 3500, "whole.gz": noise, "small": b"abc", "just": noise[:1000],
    }
    (tmp_path / "deep").mkdir()
    for name, data in contents.items():
        (tmp_path / "deep" / name).write_bytes(data)
    got = {r.path: (r.bytes, r.sha256) for r in release.checksums(spark, str(tmp_path), step=1000).collect()}
    assert got == {f"deep/{name}": (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_queries_hash_large_files_by_steps(spark, tmp_path, monkeypatch):
    import hashlib

    from lexigrid.plans.registry import QUERIES

    data = b"0123456789\n" * 1000
    (tmp_path / "large").write_bytes(data)
    seen, plain = [], release._hash_by_steps
    monkeypatch.setattr(release, "checksums", lambda spark, root, of=release.checksums: of(spark, root, 4000))
    monkeypatch.setattr(release, "_hash_by_steps", lambda *a: seen.append(a[1:]) or plain(*a))
    for name in ("file_checksums", "cache_inventory"):
        (row,) = QUERIES[name](spark, str(tmp_path)).collect()
        assert row.sha256 == hashlib.sha256(data).hexdigest()
    assert len(seen) == 2
