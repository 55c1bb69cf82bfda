import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, manifest


def document(locator="doc:1", **changes):
    child = {"key": "c1", "body": "fan", "locator": "{}", "metadata": "{}", "warnings": [], "retrieval_prefix": ""}
    context = {"key": "k1", "title": "T", "body": "the fan is loud", "children": [child, child | {"key": "c2", "body": "loud", "retrieval_prefix": "P"}]}
    return {"source": {"source_type": "manual", "canonical_locator": locator, "visibility": "public"}, "document": {"title": "D", "document_schema": "case", "schema_version": 1, "source_date": "2024-01-02", "contexts": [context]} | changes}


def test_documents_are_accepted_or_rejected_with_reasons(spark, tmp_path):
    good, other = document(), document("doc:2", title=" ")
    other["document"]["contexts"][0]["children"][0]["body"] = "not in the parent"
    for name, d in (("a", json.dumps(good)), ("b", json.dumps(other)), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(d)
    ok, bad = files.accepted(files.read_documents(spark, str(tmp_path)))
    assert ok.count() == 1 and sorted(tuple(r.broken) for r in bad.collect())[-1] == ("passages", "title")
    sources, contexts, evidence = files.tables_of(ok)
    assert sources.count() == contexts.count() == 1 and [(r.key, r.ordinal, r.retrieval_text) for r in evidence.orderBy("ordinal").collect()] == [("c1", 1, "T\nfan"), ("c2", 2, "T\nP\nloud")]
    assert sources.first().id == files.tables_of(ok)[0].first().id


def test_captures_and_raw_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"\xef\xbb\xbf<p>x</p>\r\ny")
    (tmp_path / "a.json").write_text(json.dumps({"title": "A", "url": "https://x/1"}))
    (tmp_path / "b.html").write_text("<p>b</p>")
    (tmp_path / "b.json").write_text(json.dumps({"title": "B", "url": "https://x/1"}))
    (tmp_path / "c.html").write_bytes(b"\xff\xfe\xfa")
    got = {r.item: r for r in files.read_captures(spark, str(tmp_path)).collect()}
    assert got["a"].html == "<p>x</p>\ny" and got["a"].copies == 2 and got["c"].html is None and got["c"].title is None
    reasons = {r.name: r.reason for r in files.read_raw(spark, str(tmp_path), "*.html", most=12).collect()}
    assert reasons == {"a.html": "too large", "b.html": None, "c.html": "not UTF-8"}


def test_hashes_tell_null_fields_and_listings_tell_copies(spark, tmp_path):
    one, two = document(), document()
    two["document"]["source_date"] = None
    for name, d in (("a", one), ("b", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    sources = files.tables_of(files.read_documents(spark, str(tmp_path)))[0]
    assert sources.select("content_hash").distinct().count() == 2
    folder = tmp_path / "captures"
    folder.mkdir()
    for name, url in (("a", "https://mp.x.example/s/abc?from=1"), ("b", "http://mp.x.example/s/abc"), ("c", None)):
        (folder / f"{name}.html").write_text("<p>x</p>")
        (folder / f"{name}.json").write_text(json.dumps({"title": "T"} | ({"url": url} if url else {})))
    assert [(r.identity, r["items"]) for r in files.ambiguous(files.read_captures(spark, str(folder))).collect()] == [("mp:s:abc", ["a", "b"])]


def test_spec_files_report_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"key": "a", "weight": 1.5}, {"key": "b", "weight": "heavy"}]')
    good, bad = files.readable_specs(files.read_specs(spark, str(tmp_path / "s.json"), "key string, weight double, _corrupt string").cache())
    assert good.count() == 0 and bad.count() >= 1  # one unreadable record keeps its whole file out
    (tmp_path / "t.json").write_text('[{"key": "a", "weight": 1.5}, {"key": "b"}]')
    good, bad = files.readable_specs(files.read_specs(spark, str(tmp_path / "t.json"), "key string, weight double, _corrupt string").cache())
    assert sorted(r.key for r in good.collect()) == ["a", "b"] and bad.count() == 0


def test_snapshot_paths_and_cycles(spark, tmp_path):
    toc = [{"uuid": "r", "parent_uuid": "", "title": "Root"}, {"uuid": "m", "parent_uuid": "r", "title": "Mid"}, {"uuid": "d", "parent_uuid": "m", "title": "Doc", "doc_id": 1, "url": "doc"}, {"uuid": "x", "parent_uuid": "y", "title": "X", "url": "loop"}, {"uuid": "y", "parent_uuid": "x", "title": "Y"}]
    (tmp_path / "toc.json").write_text(json.dumps({"data": toc}))
    (tmp_path / "docs.json").write_text(json.dumps({"data": [{"id": 1, "slug": "doc", "title": "Doc", "content_updated_at": "2024-01-01T20:00:00Z"}, {"id": 2, "slug": "loop", "title": "Loop", "content_updated_at": None}]}))
    (tmp_path / "doc.md").write_text("# Doc")
    got = {r.slug: r for r in files.read_snapshot(spark, str(tmp_path)).collect()}
    assert got["doc"].collection_path == ["Root", "Mid"] and got["doc"].text == "# Doc" and str(got["doc"].updated_on) == "2024-01-02" and got["loop"].collection_path == ["Y"]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.toml").write_text('source_type = "book"\n[collections.b]\nvisibility = "internal"\n[[path_rules]]\npath = ["a"]\ncategory = "guide"\n[[path_rules]]\npath = ["a", "x"]\ncategory = "case"\n[docs."b/2"]\ncategory = "skip"\nvisibility = "public"\n')
    m = manifest.Manifest.load(str(tmp_path / "m.toml"))
    items = spark.createDataFrame([("b/1", ["a", "x", "y"]), ("b/2", ["a"]), ("b/3", ["q"])], "key string, path array<string>")
    got = {r.key: (r.category, r.classified_by, r.visibility) for r in m.classify(spark, items, "key", F.col("path")).collect()}
    assert got == {"b/1": ("case", "path", "internal"), "b/2": ("skip", "document", "public"), "b/3": (None, None, "internal")}
    status = manifest.route_status(F.lit(None), F.lit(True), F.col("c"), ("guide",))
    assert [r[0] for r in spark.createDataFrame([("guide",), ("skip",), (None,), ("other",)], "c string").select(status).collect()] == ["processed", "skipped", "unregistered", "skipped"]
    with pytest.raises(ValueError):
        manifest.Manifest("book", {"../x": "public"})
