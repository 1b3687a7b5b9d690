import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from recordloom.operators import records, selection, site
from recordloom.sources import api, commits, database, files, snapshot
from recordloom.streaming import debounce, outputs, watch


def make_database(path, versions=(2, 16, 1), items=10):
    db = sqlite3.connect(path)
    db.execute("create table manifest(id integer, storage_version integer, ir_version integer, encoding_version integer, producer text, content_fingerprint text)")
    db.execute("create table records(kind text, owner text, id text, content text, fingerprint text)")
    db.execute("create table assets(digest text, media_type text, bytes blob)")
    db.execute("insert into manifest values (1, ?, ?, ?, 'me', '')", versions)
    db.execute("insert into records values ('package', '', 'p', '{}', '')")
    db.executemany("insert into records values ('item', 'p', ?, '{}', '')", [(f"i{n}",) for n in range(items)])
    db.execute("insert into assets values (?, 'text/plain', ?)", (hashlib.sha256(b"x").hexdigest(), b"x"))
    db.commit()
    db.close()


def test_snapshot_round_trip(spark, tmp_path):
    make_database(tmp_path / "s.db")
    tables = database.read_snapshot(spark, str(tmp_path / "s.db"))
    assert tables["records"].count() == 11 and tables["assets"].count() == 1
    assert snapshot.verify(tables).count() == 0
    snapshot.publish(tables, str(tmp_path / "out"))
    back = snapshot.published(spark, str(tmp_path / "out"))
    assert back["records"].exceptAll(tables["records"]).count() == 0
    assert snapshot.export_lines(back).count() == 12
    snapshot.write_lines(snapshot.export_lines(back), str(tmp_path / "lines"))
    lines = [r.value for f in sorted((tmp_path / "lines").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert len(lines) == 12 and "package" in lines[10] and '"digest"' in lines[11]
    # A second version replaces the first in one step; a reader finds one at any time.
    snapshot.publish(back, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*/records"))) == 2 and snapshot.published(spark, str(tmp_path / "out"))["records"].count() == 11
    # With the domain of the producer the digests of records are held against their contents.
    signed = records.with_fingerprints(back["records"], domain="d")
    assert snapshot.verify(back | {"records": signed}, "d").count() == 0
    assert snapshot.verify(back | {"records": signed}, "e").count() == 11


def test_snapshots_and_bundles_are_told_apart(spark, tmp_path):
    make_database(tmp_path / "s.db")
    make_database(tmp_path / "b.db")
    db = sqlite3.connect(tmp_path / "b.db")
    db.execute(f"pragma application_id = {database.BUNDLE_ID}")
    db.execute("pragma user_version = 1")
    db.commit()
    db.close()
    assert database.read_snapshot(spark, str(tmp_path / "b.db"), bundle=True)["records"].count() == 11
    for name, bundle in (("s.db", True), ("b.db", False)):
        with pytest.raises(Exception, match="a bundle of one package"):
            database.read_snapshot(spark, str(tmp_path / name), bundle)["records"].count()
    (tmp_path / "b.db-wal").write_text("")
    with pytest.raises(ValueError, match="recovery files"):
        database.open_snapshot(str(tmp_path / "b.db"), bundle=True)
    (tmp_path / "wal.db").write_bytes(b"SQLite format 3\0\x10\0\2\2")
    with pytest.raises(ValueError, match="rollback journal"):
        database.open_snapshot(str(tmp_path / "wal.db"))


def test_snapshot_refuses_other_versions_and_broken_tables(spark, tmp_path):
    make_database(tmp_path / "s.db", versions=(2, 15, 1))
    with pytest.raises(Exception, match="unknown snapshot versions"):
        database.read_snapshot(spark, str(tmp_path / "s.db"))["records"].count()
    make_database(tmp_path / "t.db")
    tables = database.read_snapshot(spark, str(tmp_path / "t.db"))
    broken = tables | {"records": tables["records"].where("kind <> 'package'")}
    with pytest.raises(ValueError, match="orphan-owner"):
        snapshot.publish(broken, str(tmp_path / "out"))
    assert commits.CommitLog(spark, str(tmp_path / "out")).latest() is None and not list((tmp_path / "out").glob("*/records"))


def test_bundles_and_write_once(spark):
    schema = snapshot.SCHEMAS["records"]
    assets = spark.createDataFrame([], snapshot.SCHEMAS["assets"])
    repo = ("repository", "", "r", "{}", "")
    base = {"records": spark.createDataFrame([("package", "", "p", '{"slug":"s"}', ""), repo], schema), "assets": assets}

    def bundle(*rows):
        return {"records": spark.createDataFrame(list(rows), schema), "assets": assets}

    new = ("package", "", "q", '{"slug":"t"}', "")
    assert snapshot.import_bundle(base, bundle(new, ("item", "q", "i", "{}", ""), repo))["records"].count() == 4
    with pytest.raises(ValueError, match="already there"):
        snapshot.import_bundle(base, base)
    with pytest.raises(ValueError, match="already there"):
        snapshot.import_bundle(base, bundle(new, ("repository", "", "r", '{"x":1}', "")))
    with pytest.raises(ValueError, match="slug"):
        snapshot.import_bundle(base, bundle(("package", "", "q", '{"slug":"s"}', ""), repo))
    for wrong in ([new], [new, repo, ("concept", "", "c", "{}", "")], [new, ("package", "", "z", "{}", ""), repo]):
        with pytest.raises(ValueError, match="one package and one repository"):
            snapshot.import_bundle(base, bundle(*wrong))
    cache = spark.createDataFrame([("k", "v")], "key string, payload string")
    assert snapshot.insert_once(cache, spark.createDataFrame([("k", "v"), ("l", "w")], "key string, payload string"), "key", "payload").count() == 1
    with pytest.raises(ValueError, match="several payloads"):
        snapshot.insert_once(cache, spark.createDataFrame([("l", "w"), ("l", "x")], "key string, payload string"), "key", "payload")
    with pytest.raises(ValueError, match="other payloads"):
        snapshot.insert_once(cache, spark.createDataFrame([("k", "x")], "key string, payload string"), "key", "payload")


def test_file_tree(spark, tmp_path):
    for name in ("a.md", "sub/b.qmd", "node_modules/c.md", "d.txt", "out/gen/e.md", "sub/.git/f.md", "z.Rmd"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("x")
    assert [r.relative for r in files.pages_in(spark, str(tmp_path), generated="out/gen").collect()] == ["a.md", "sub/b.qmd", "z.Rmd"]
    assert [r.relative for r in files.pages_in(spark, str(tmp_path), formats=["rmarkdown"]).collect()] == ["z.Rmd"]


def test_config_refuses_unknown_keys(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"project": {"name": "x", "odd": 1}}')
    with pytest.raises(ValueError, match="odd"):
        files.read_config(spark, str(tmp_path / "c.json"), {"": {"project"}, "project": {"name"}})


def test_source_discovery(spark):
    table = spark.createDataFrame([(p,) for p in ("src/a/__init__.py", "src/a/b.pyi", "src/a/b.py", "c.py", "r/DESCRIPTION", "r/R/x.R", "r/man/x.Rd", "r/NAMESPACE", "r/R/sub/y.R", "z/R/w.R")], "relative string")
    got = sorted((r.root, r.module, r.stub) for r in files.python_sources(table, ["", "src"]).collect())
    assert got == [("", "c", False), ("src", "a", False), ("src", "a.b", False), ("src", "a.b", True)]
    got = sorted((r.package, r.kind) for r in files.r_sources(table).collect())
    assert got == [("r", "description"), ("r", "help"), ("r", "namespace"), ("r", "source")]
    got = {r.name: r.digest for r in files.environment(spark, ["A", "B"], {"A": "x"}).collect()}
    assert got == {"A": hashlib.sha256(b"x").hexdigest(), "B": None}


def test_url_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 1,\n "documents": {"a.html": "/a"}, "assets": {"assets/x.css": "https://c/x.css"}}')
    assert sorted(tuple(r) for r in files.url_map(spark, str(tmp_path / "m.json")).collect()) == [("assets", "assets/x.css", "https://c/x.css"), ("documents", "a.html", "/a")]
    (tmp_path / "n.json").write_text('{"version": 2}')
    with pytest.raises(ValueError, match="version 1"):
        files.url_map(spark, str(tmp_path / "n.json"))


def test_configuration_events_and_first_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"project": {"name": "x"}}')
    assert files.read_config(spark, str(tmp_path / "c.json"), {"": {"project"}, "project": {"name"}}) == {"project": {"name": "x"}}
    (tmp_path / "e.json").write_text('{"sample":"1","event":"start","id":"a","at":1.5}\n')
    assert files.event_log(spark, str(tmp_path / "e.json")).first().at == 1.5
    rows = spark.createDataFrame([("p", "NEWS", "c"), ("p", "NEWS.md", "a"), ("q", "README", "x")], "folder string, name string, content string")
    assert [tuple(r) for r in files.first_of(rows, ["NEWS.md", "NEWS.Rd", "NEWS"]).collect()] == [("p", "NEWS.md", "a")]
    listed = files.manifest(spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary"), spark.createDataFrame([("a",), ("b",)], "path string"))
    assert {r.path: r.digest for r in listed.collect()} == {"a": hashlib.sha256(b"x").hexdigest(), "b": None}


RUSTDOC = """{"root": 0, "format_version": 61, "includes_private": false, "index": {
 "0": {"id": 0, "crate_id": 0, "name": "c", "visibility": "public", "attrs": [], "docs": "D", "inner": {"module": {"is_crate": true, "items": [1, 2, 5, 6]}}},
 "1": {"id": 1, "crate_id": 0, "name": "m", "visibility": "public", "attrs": [], "docs": null, "inner": {"module": {"items": [3, 4]}}},
 "2": {"id": 2, "crate_id": 0, "name": null, "visibility": "public", "attrs": [], "docs": null, "inner": {"use": {"source": "m::S", "name": "T", "id": 3, "is_glob": false}}},
 "3": {"id": 3, "crate_id": 0, "name": "S", "visibility": "public", "attrs": [], "docs": null, "inner": {"struct": {"kind": {"plain": {"fields": [7], "has_stripped_fields": false}}, "impls": []}}},
 "4": {"id": 4, "crate_id": 0, "name": "secret", "visibility": "public", "attrs": ["#[doc(hidden)]"], "docs": null, "inner": {"function": {}}},
 "5": {"id": 5, "crate_id": 0, "name": "private", "visibility": "crate", "attrs": [], "docs": null, "inner": {"function": {}}},
 "6": {"id": 6, "crate_id": 0, "name": null, "visibility": "public", "attrs": [], "docs": null, "inner": {"use": {"source": "m", "name": "m", "id": 1, "is_glob": true}}},
 "7": {"id": 7, "crate_id": 0, "name": "f", "visibility": "public", "attrs": [], "docs": null, "inner": {"struct_field": {}}}}}"""


def test_rustdoc_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(RUSTDOC)
    index = api.rust_index(spark, str(tmp_path / "c.json"))
    assert sorted((r.id, r.kind, r.public, r.hidden) for r in index.collect())[:3] == [(0, "module", True, False), (1, "module", True, False), (2, "use", True, False)]
    children = sorted((r.parent, r.ord, r.child, r.name, r.use_name, r.glob) for r in api.rust_children(index).where("parent in (0, 3)").collect())
    assert children == [(0, 0, 1, "m", None, False), (0, 1, 3, None, "T", False), (0, 2, 5, "private", None, False), (0, 3, 1, None, None, True), (3, 0, 7, "f", None, False)]
    exports = api.rust_exports(index).select(*[F.col(c).cast("string") for c in ("module", "name", "target")])
    paths = selection.public_paths(exports, spark.createDataFrame([("0", "c")], "module string, path string"))
    assert sorted((r.item, r.path) for r in paths.collect()) == [("3", "c::S"), ("3", "c::T"), ("3", "c::m::S")]
    (tmp_path / "d.json").write_text('{"root": 0, "format_version": 60, "index": {}}')
    with pytest.raises(ValueError, match="format 61"):
        api.rust_index(spark, str(tmp_path / "d.json"))


def test_doxygen_files(spark, tmp_path):
    (tmp_path / "index.xml").write_text('<doxygenindex><compound refid="classA" kind="class"><name>A</name></compound><compound refid="p" kind="page"><name>P</name></compound><compound refid="gone" kind="file"><name>G</name></compound></doxygenindex>')
    member = '<memberdef kind="function" id="{id}" prot="{prot}" static="{static}" virt="{virt}"><name>{id}</name><definition>void {id}</definition><argsstring>()</argsstring></memberdef>'
    rows = [("a", "public", "no", "non-virtual"), ("b", "private", "no", "virtual"), ("c", "private", "no", "non-virtual")]
    text = "".join(member.format(id=i, prot=p, static=s, virt=v) for i, p, s, v in rows)
    (tmp_path / "classA.xml").write_text(f'<doxygen><compounddef id="classA" kind="class"><compoundname>A</compoundname><sectiondef kind="x">{text}</sectiondef></compounddef></doxygen>')
    index, members = api.doxygen_index(spark, str(tmp_path / "index.xml")), api.doxygen_members(spark, str(tmp_path / "classA.xml"))
    assert sorted(r.refid for r in index.collect()) == ["classA", "gone"]
    assert [(r.id, r.ord, r.is_member, r.definition) for r in members.orderBy("ord").collect()] == [("a", 0, True, "void a"), ("b", 1, True, "void b"), ("c", 2, True, "void c")]
    assert [r.id for r in selection.native_members(members, extract_virtual=True).orderBy("ord").collect()] == ["a", "b"]
    assert [r.refid for r in api.doxygen_missing(index, members).collect()] == ["gone"]


def test_cached_results(spark):
    requests = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    entries = spark.createDataFrame([(k, "{}") for k in "abcd"] + [("e", "{broken")], "key string, payload string")
    recorded = spark.createDataFrame([("a", "x", "1"), ("a", "gone", None), ("b", "x", "2"), ("c", "y", None), ("e", "x", "1")], "key string, path string, state string")
    current = spark.createDataFrame([("x", "1"), ("y", "9")], "path string, state string")
    got = {r.key: (r.hit, r.reason) for r in watch.cache_hits(requests, entries, recorded, current).collect()}
    assert got == {"a": (True, None), "b": (False, "inputs-changed"), "c": (False, "inputs-changed"), "d": (False, "no-inputs"), "e": (False, "broken-payload"), "f": (False, "no-entry")}
    parts = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1"), ("q", "a", None)], "page string, name string, value string")
    keys = {r.page: r.key for r in watch.page_keys(parts).collect()}
    assert keys["p"] == hashlib.sha256(b'recordloom/page-v1\0{"a":"1","b":"2"}').hexdigest() and keys["q"] == hashlib.sha256(b'recordloom/page-v1\0{"a":null}').hexdigest()
    tree = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "path string, target string")
    assert sorted(r.path for r in watch.link_cycles(tree).collect()) == ["a", "b"]


def test_published_files(spark, tmp_path):
    tree = spark.createDataFrame([("index.html", bytearray(b"1")), ("a/b.html", bytearray(b"2"))], "path string, bytes binary")
    site.publish_files(tree, str(tmp_path / "site"))
    site.publish_files(tree.where("path = 'index.html'"), str(tmp_path / "site"))
    assert [r.path for r in site.published_files(spark, str(tmp_path / "site")).collect()] == ["index.html"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "mine.txt").write_text("x")
    with pytest.raises(ValueError, match="not published here"):
        site.publish_files(tree, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="several files"):
        site.publish_files(tree.unionAll(tree), str(tmp_path / "third"))


def event(seq, cell, kind, payload=None, name=None, display_id=None, wait=False):
    return ("p", seq, cell, kind, name, payload, display_id, wait)


def test_outputs_fold(spark):
    events = [
        event(0, 1, "stream", "a", "stdout"), event(1, 1, "stream", "b", "stdout"), event(2, 1, "display", "old", display_id="d"),
        event(3, 2, "update", "new", display_id="d"), event(4, 2, "stream", "x", "stdout"), event(5, 2, "clear", wait=True), event(6, 2, "stream", "y", "stdout"),
    ]
    df = spark.createDataFrame(events, "page string, seq long, cell long, kind string, name string, payload string, display_id string, wait boolean")
    got = [(r.cell, r.position, r.payload) for r in outputs.reduce_outputs(df).orderBy("cell", "position").collect()]
    assert got == [(1, 0, "ab"), (1, 1, "new"), (2, 0, "y")]
    lost = outputs.reduce_outputs(df.where("seq = 3")).collect()
    assert [(r.cell, r.position, r.payload, r.problem) for r in lost] == [(2, None, "d", "unknown-display")]


def test_watch_publishes_changes_once(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()

    def publish(changes, number):
        seen.append(sorted((r.path, r.change) for r in changes.collect()))

    def turn(lines):
        (log / f"{len(list(log.iterdir()))}.json").write_text("\n".join(lines))
        watch.watch(watch.stream_observations(spark, str(log)), str(tmp_path / "state"), publish, str(tmp_path / "cp")).awaitTermination()

    turn(['{"path":"a","state":"1","at":"2024-01-01T00:00:00"}', '{"path":"b","state":"1","at":"2024-01-01T00:00:00"}'])
    turn(['{"path":"a","state":"2","at":"2024-01-01T00:00:01"}', '{"path":"b","state":"removed","at":"2024-01-01T00:00:01"}'])
    assert seen == [[("a", "added"), ("b", "added")], [("a", "modified"), ("b", "removed")]]
    turn(['{"path":"a","state":"removed","at":"2024-01-01T00:00:02"}'])
    # No path is left, which is a state as well: what comes next is new.
    turn(['{"path":"b","state":"3","at":"2024-01-01T00:00:03"}'])
    assert seen[2:] == [[("a", "removed")], [("b", "added")]]


def test_watch_tries_failed_changes_again(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()
    (log / "0.json").write_text('{"path":"a","state":"1","at":"2024-01-01T00:00:00"}')

    def run(publish):
        watch.watch(watch.stream_observations(spark, str(log)), str(tmp_path / "state"), publish, str(tmp_path / "cp")).awaitTermination()

    def fails(changes, number):
        raise RuntimeError("no space")

    with pytest.raises(Exception, match="no space"):
        run(fails)
    run(lambda changes, number: seen.append([(r.path, r.change) for r in changes.collect()]))
    assert seen == [[("a", "added")]] and watch.states(spark, str(tmp_path / "state" / "CURRENT")) == [0]


def test_watch_parts(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, state string")
    files_ = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    seen = {r.path: r.state for r in watch.observe(files_, spark.createDataFrame([("a",), ("z",)], "path string")).collect()}
    assert seen == {"a": hashlib.sha256(b"x").hexdigest(), "z": "missing"}
    listing = spark.createDataFrame([("a", "s1"), ("b", "s2")], "path string, stamp string")
    known = spark.createDataFrame([("a", "s1", "d"), ("b", "old", "e")], "path string, stamp string, digest string")
    assert {r.path: r.digest for r in watch.reuse_digests(listing, known).collect()} == {"a": "d", "b": None}
    changes = spark.createDataFrame([("a", "modified"), ("b", "modified")], "path string, change string")
    assert [r.path for r in watch.unacknowledged(changes, now, spark.createDataFrame([("a", "1"), ("b", "1")], "path string, state string")).collect()] == ["b"]
    assert watch.inputs_match(now, now).first().ok and not watch.inputs_match(now, now.limit(1)).first().ok
    assert watch.change_lines(changes, "s").first().value == '{"snapshot":"s","changed":["a","b"]}'


def test_debounce(spark):
    df = spark.sql("select * from values ('a', 's', timestamp'2024-01-01 00:00:00.000'), ('b', 's', timestamp'2024-01-01 00:00:00.100'), ('a', 's', timestamp'2024-01-01 00:00:01') as t(path, state, at)")
    assert sorted(r.paths for r in debounce.settled_changes(df).collect()) == [["a"], ["a", "b"]]
