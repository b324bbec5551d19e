import json
import re

import pytest

from pinion import cli
from pinion.collection import Database
from pinion.errors import ALREADY_EXISTS, FAILED_PRECONDITION, INTERNAL, INVALID_ARGUMENT, NOT_FOUND, PERMISSION_DENIED, StatusError
from pinion.plans.planner import HnswSearch, IvfSearch, VectorQuery
from pinion.schema import BOOL, HNSW, INT64, IVF, STRING, Doc, HnswParams, IvfParams, Options, ScalarField
from pinion.sources.jsonl import parse_vector, read_docs, scan_docs
from pinion.streaming.ingest import upsert_stream

#: Three directions at right angles, of length 2.5.
EAST, NORTH, UP = [0.0, 0.0, 1.5, 2.0], [2.0, -1.5, 0.0, 0.0], [1.5, 2.0, 0.0, 0.0]


def near(axis, other, share):
    return [a + share * b for a, b in zip(axis, other, strict=True)]


SEED = [
    ("item-1", 1, "red", 0.5, EAST),
    ("item-2", 2, "red", 1.0, near(EAST, NORTH, 0.25)),
    ("item-3", 3, "blue", 1.5, NORTH),
    ("item-4", 4, "green", 2.0, UP),
    ("item-5", 5, "red", 2.5, near(EAST, UP, 0.125)),
    ("item-6", 6, "blue", 3.0, near(NORTH, UP, 0.125)),
    ("item-7", 7, "blue", 3.5, near(NORTH, EAST, 0.25)),
    ("item-8", 8, "green", 4.0, near(UP, EAST, 0.125)),
]


def docs(n=8, first=0):
    return [Doc(i, {"pk": i, "rank": r, "category": c, "score": s}, v) for i, r, c, s, v in SEED[first:n]]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path))


@pytest.fixture
def coll(db):
    c = db.create_collection(cli.default_schema("docs", 4, "Cosine"), Options(segment_max_docs=2))
    yield c
    c.close()


def ids(c, vector, k=10, **kw):
    return [d.id for d in c.query(VectorQuery("embedding", k, vector, **kw))]


def test_queries_filters_and_projection(coll):
    assert all(r.ok for r in coll.insert(docs(4)))
    hits = coll.query(VectorQuery("embedding", 2, EAST))
    assert hits[0].id == "item-1" and hits[0].vector == [] and hits[0].score == 1.0
    hits = coll.query(VectorQuery("embedding", 9, EAST, filter="category = 'red' AND rank >= 2", fields=["rank", "category"]))
    assert [(d.id, d.fields) for d in hits] == [("item-2", {"rank": 2, "category": "red"})]
    assert ids(coll, EAST, filter="category LIKE 'r%' AND category CONTAINS 'ed'") == ["item-1", "item-2"]
    assert coll.query(VectorQuery("embedding", 1, by_id="item-3"))[0].id == "item-3"
    for bad in ("nope = 1", "rank = 'x'", "category LIKE 'a%b%c'"):
        with pytest.raises(StatusError):
            ids(coll, EAST, filter=bad)
    with pytest.raises(StatusError) as e:
        coll.query(VectorQuery("embedding", 1, by_id="nope"))
    assert e.value.code == NOT_FOUND


def test_ties_break_by_public_id(coll):
    two = [Doc(i, {"pk": i, "rank": 1, "category": "c", "score": 0.0}, EAST) for i in ("item-b", "item-a", "item-c")]
    coll.insert(two)
    assert ids(coll, EAST, 1) == ["item-a"]


def test_dml_statuses_and_reopen(db, coll):
    coll.insert(docs(4))
    coll.flush()
    assert [r.code for r in coll.insert([docs(1)[0], docs(5, 4)[0], docs(5, 4)[0]])] == [ALREADY_EXISTS, "Ok", ALREADY_EXISTS]
    assert coll.update([Doc("item-1", {"rank": 11})])[0].ok and coll.update([Doc("nope", {"rank": 1})])[0].code == NOT_FOUND
    assert coll.fetch(["item-1", "item-1", "nope"])["item-1"].fields == {"pk": "item-1", "rank": 11, "category": "red", "score": 0.5}
    assert [r.code for r in coll.delete(["item-2", "item-2"])] == ["Ok", NOT_FOUND]
    assert coll.upsert([Doc("item-3", {"pk": "item-3", "rank": 33, "category": "blue", "score": 1.0}, NORTH)])[0].ok
    bad = [Doc("x", {"pk": "y", "rank": 1, "category": "c", "score": 0.0}, [1.0] * 4), Doc("x", {"pk": "x", "rank": 1.5, "category": "c", "score": 0.0}, [1.0] * 4), Doc("x", {"pk": "x"}, [1.0] * 4), Doc("x", docs(1)[0].fields, [1.0])]
    assert {r.code for r in coll.insert(bad)} == {INVALID_ARGUMENT}
    coll.delete_by_filter("category = 'green'")
    before = sorted((d.id, d.fields["rank"]) for d in coll.query(VectorQuery("embedding", 9, EAST)))
    assert before == [("item-1", 11), ("item-3", 33), ("item-5", 5)]
    with pytest.raises(StatusError) as e:
        db.open_collection("docs")
    assert e.value.code == FAILED_PRECONDITION
    coll.close()
    with db.open_collection("docs") as again:  # from the operation log
        assert sorted((d.id, d.fields["rank"]) for d in again.query(VectorQuery("embedding", 9, EAST))) == before
        again.optimize()
        assert again.stats() == {"doc_count": 3, "segment_count": 3}
    with db.open_collection("docs") as again:
        assert sorted((d.id, d.fields["rank"]) for d in again.query(VectorQuery("embedding", 9, EAST))) == before
        assert again.fetch(["item-1"])["item-1"].vector == EAST


class Broken(Exception):
    pass


def fails_at(monkeypatch, files, start):
    """Writing of a file whose name begins with `start` fails."""
    write = files.write

    def failing(name, text):
        if name.startswith(start):
            raise Broken(name)
        write(name, text)

    monkeypatch.setattr(files, "write", failing)


@pytest.mark.parametrize("kind", [HNSW, IVF])
def test_a_crash_at_any_step_of_a_checkpoint_loses_nothing(db, coll, monkeypatch, kind):
    coll.insert(docs(4))
    coll.create_index("embedding", kind)
    coll.insert(docs(6, 4))
    before = ids(coll, EAST)
    build = coll._build_indexes

    def broken(*args):
        build(*args)
        raise Broken

    with monkeypatch.context() as m:  # while indexes are written
        m.setattr(coll, "_build_indexes", broken)
        with pytest.raises(Broken):
            coll.flush()
    assert ids(coll, EAST) == before
    with monkeypatch.context() as m:  # just before the commit
        fails_at(m, coll.files, "manifest")
        with pytest.raises(Broken):
            coll.flush()
    assert ids(coll, EAST) == before
    with monkeypatch.context() as m:  # right after the commit, before anything old is deleted
        m.setattr(coll, "_collect_garbage", lambda: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Broken):
            coll.flush()
    coll.close()
    with db.open_collection("docs") as again:
        assert ids(again, EAST) == before and again.stats()["doc_count"] == 6
        again.insert(docs(8, 6))
        again.optimize()
        assert len(ids(again, EAST)) == 8


def test_failed_schema_changes_change_nothing(coll, monkeypatch):
    coll.insert(docs(4))
    coll.flush()
    coll.insert(docs(6, 4))
    state = (coll.schema, coll.version, coll.next_id, coll.next_segment, coll.writing, dict(coll.delta))
    with monkeypatch.context() as m:
        fails_at(m, coll.files, "manifest")
        changes = (
            lambda: coll.add_column(ScalarField("x", INT64, default=1)),
            lambda: coll.rename_column("rank", "place"),
            lambda: coll.drop_column("rank"),
            lambda: coll.create_index("embedding", IVF),
            lambda: coll.create_index("rank", "Scalar"),
            lambda: coll.append_frame(coll.live().drop("_doc_id", "segment_id")),
            lambda: coll.optimize(),
        )
        for change in changes:
            with pytest.raises(Broken):
                change()
            assert (coll.schema, coll.version, coll.next_id, coll.next_segment, coll.writing, dict(coll.delta)) == state
    assert ids(coll, EAST, filter="rank > 0", k=9) == ids(coll, EAST, k=9) and len(ids(coll, EAST)) == 6


def test_delete_by_filter_is_a_table_of_tombstones(db, coll, tmp_path):
    coll.insert(docs(6))
    coll.flush()
    coll.insert(docs(8, 6))
    coll.delete_by_filter("rank >= 6")
    assert [p.name for p in (tmp_path / "docs" / "tombs").iterdir()] and ids(coll, NORTH) == ["item-3", "item-2", "item-1", "item-4", "item-5"]
    assert coll.insert(docs(6, 5))[0].ok and coll.delete(["item-7"])[0].code == NOT_FOUND and coll.update([Doc("item-8", {"rank": 1})])[0].code == NOT_FOUND
    coll.delete_by_filter("rank = 1")
    before = sorted(ids(coll, NORTH))
    assert before == ["item-2", "item-3", "item-4", "item-5", "item-6"]
    coll.close()
    with db.open_collection("docs") as again:
        assert sorted(ids(again, NORTH)) == before
        again.flush()
        assert sorted(ids(again, NORTH)) == before and not list((tmp_path / "docs" / "tombs").iterdir())


def test_a_scalar_index_skips_segments(coll):
    coll.insert(docs(8))  # four segments of two
    before = ids(coll, EAST, filter="rank >= 3 AND rank < 5")
    coll.create_index("rank", "Scalar")
    coll.create_index("category", "Scalar")

    def read(text):
        q = VectorQuery("embedding", 9, EAST, filter=text)
        plan = coll.query_frame(q)._jdf.queryExecution().executedPlan().toString()
        return set(map(int, re.findall(r"\d+", plan.split("PartitionFilters: [")[1].split("]")[0].replace("segment_id#", "_")))) & {s["segment_id"] for s in coll.segments}

    numbers = [s["segment_id"] for s in coll.segments]
    assert ids(coll, EAST, filter="rank >= 3 AND rank < 5") == before and read("rank >= 3 AND rank < 5") == {numbers[1]}
    assert read("category = 'green' AND rank > 6") == {numbers[3]} and ids(coll, EAST, filter="category = 'green' AND rank > 5") == ["item-8"]
    assert ids(coll, EAST, filter="rank > 99") == [] and len(ids(coll, EAST, filter="rank > 99 OR rank = 1")) == 1
    coll.insert([Doc("item-9", {"pk": "item-9", "rank": 4, "category": "red", "score": 0.0}, EAST)])
    assert ids(coll, EAST, filter="rank = 4") == ["item-9", "item-4"]
    k = coll.segments[2]["min_id"]
    assert [r["_doc_id"] for r in coll.fetch_internal([k, 10**6]).collect()] == [k]
    coll.drop_index("rank", "Scalar")
    assert ids(coll, EAST, filter="rank = 4") == ["item-9", "item-4"]


def test_indexes_are_checked_when_opened(db, coll, spark, tmp_path):
    coll.insert(docs(8))
    coll.create_index("embedding", HNSW)
    version, root = coll.version, tmp_path / "docs"
    coll.close()
    at = f"{root}/index/v={version}/hnsw"
    good = spark.read.parquet(at).collect()
    for bad in ((1, 0, good[0]["a"], 999), (1, 0, good[0]["a"], good[0]["a"])):
        spark.createDataFrame([*good, bad], "segment_id long, level int, a long, b long").write.mode("overwrite").parquet(at)
        with pytest.raises(StatusError) as e:
            db.open_collection("docs")
        assert e.value.code == INTERNAL


def test_columns(coll):
    coll.insert(docs(4))
    coll.add_column(ScalarField("nickname", STRING, nullable=True))
    coll.update([Doc("item-1", {"nickname": "one"})])
    assert ids(coll, EAST, filter="nickname IS NULL") == ["item-2", "item-3", "item-4"]
    coll.add_column(ScalarField("is_public", BOOL, default=True))
    assert coll.fetch(["item-2"])["item-2"].fields["is_public"] is True
    coll.insert([Doc("item-9", {"pk": "item-9", "rank": 9, "category": "c", "score": 0.0}, EAST)])
    assert coll.fetch(["item-9"])["item-9"].fields["is_public"] is True and "nickname" not in coll.fetch(["item-9"])["item-9"].fields
    assert ids(coll, EAST, filter="nickname != 'x'") == ["item-1", "item-2", "item-3", "item-4"]  # missing: no
    coll.create_index("category", "Scalar")
    coll.rename_column("category", "label")
    assert coll.schema.field("label").indexed
    assert ids(coll, EAST, filter="label = 'red'") == ["item-1", "item-2"]
    coll.drop_column("label")
    for bad, code in ((lambda: coll.drop_column("pk"), INVALID_ARGUMENT), (lambda: coll.drop_column("nope"), NOT_FOUND), (lambda: coll.add_column(ScalarField("rank", INT64)), ALREADY_EXISTS), (lambda: coll.add_column(ScalarField("z", INT64)), INVALID_ARGUMENT), (lambda: coll.create_index("nickname", "Scalar"), INVALID_ARGUMENT), (lambda: coll.create_index("rank", HNSW), INVALID_ARGUMENT)):
        with pytest.raises(StatusError) as e:
            bad()
        assert e.value.code == code


@pytest.mark.parametrize(("kind", "params", "search"), [(IVF, IvfParams(64, 1, 4), IvfSearch(1)), (HNSW, HnswParams(ef_search=1), HnswSearch(1))])
def test_approximate_indexes(coll, kind, params, search):
    coll.insert(docs(4))
    coll.create_index("embedding", kind, params)
    got = ids(coll, EAST, 4, search=search)
    assert got[0] == "item-1" and len(got) == (2 if kind == IVF else 4)  # one probe in each of two segments
    assert ids(coll, EAST, 1, filter="category = 'blue'", search=search) == ["item-3"]  # a filter widens
    coll.delete(["item-1"])
    assert ids(coll, EAST, 1, search=search) == ["item-2"]
    coll.insert(docs(8, 4))
    assert ids(coll, EAST, 1, search=search) == ["item-5"]
    coll.flush()
    assert set(ids(coll, NORTH, 3, filter="rank > 0")) == {"item-3", "item-6", "item-7"}
    with pytest.raises(StatusError):
        ids(coll, EAST, 1, search=IvfSearch(1) if kind == HNSW else HnswSearch(1))
    coll.drop_index("embedding", kind)
    assert len(ids(coll, EAST, 9)) == 7


def test_read_only_and_corruption(db, coll, tmp_path):
    coll.insert(docs(2))
    coll.flush()
    coll.close()
    manifest = max((tmp_path / "docs").glob("manifest.*.json"))
    good = manifest.read_text()
    manifest.write_text(good.replace('"ReadWrite"', '"ReadOnly"'))
    with pytest.raises(StatusError) as e:  # its checksum fails
        db.open_collection("docs")
    assert e.value.code == INTERNAL
    for crc in (tmp_path / "docs").glob(".*.crc"):
        crc.unlink()
    with db.open_collection("docs") as c:
        assert c.insert(docs(3, 2))[0].code == PERMISSION_DENIED and len(ids(c, EAST)) == 2
        with pytest.raises(StatusError):
            c.flush()
    manifest.write_text(good[:40])
    with pytest.raises(StatusError):
        db.open_collection("docs")
    with pytest.raises(StatusError) as e:
        db.open_collection("nope")
    assert e.value.code == NOT_FOUND


def line(d):
    return json.dumps({"id": d.id, "fields": d.fields, "vector": d.vector})


def test_bulk_and_streaming(spark, coll, tmp_path):
    coll.insert(docs(2))
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(map(line, docs(6))) + "\n\n")
    coll.append_frame(scan_docs(spark, str(src), coll.schema))
    assert coll.stats()["doc_count"] == 6
    assert ids(coll, EAST, 2) == ["item-1", "item-5"]
    (src / "b.jsonl").write_text("\n".join(map(line, docs(8, 6))))
    upsert_stream(coll, str(src), str(tmp_path / "chk")).awaitTermination(120)
    assert coll.stats()["doc_count"] == 8
    with pytest.raises(StatusError):
        read_docs(str(_write(tmp_path / "bad", '{"id": "x", "vector": [1.0]}')))
    with pytest.raises(StatusError):
        read_docs(str(_write(tmp_path / "bad", '{"id": "x", "fields": {"a": 18446744073709551615}, "vector": [1.0]}')))
    assert parse_vector("1, 2.5,3") == [1.0, 2.5, 3.0]


@pytest.mark.parametrize(
    "bad",
    [
        {"id": "x", "fields": {"pk": "y", "rank": 1, "category": "c", "score": 0.5}},
        {"id": "x", "fields": {"pk": "x", "category": "c", "score": 0.5}},
        {"id": "x", "fields": {"pk": "x", "rank": None, "category": "c", "score": 0.5}},
        {"id": "x", "fields": {"pk": "x", "rank": 1.5, "category": "c", "score": 0.5}},
        {"id": "x", "fields": {"pk": "x", "rank": 1, "category": "c", "score": 0.5, "more": [1]}},
        {"id": "x", "fields": {"pk": "x", "rank": 1, "category": "c", "score": 0.5}, "vector": [1.0, 2.0]},
        {"id": None, "fields": {"pk": "x", "rank": 1, "category": "c", "score": 0.5}},
        {"id": "", "fields": {"pk": "", "rank": 1, "category": "c", "score": 0.5}},
    ],
)
def test_bulk_rows_are_checked_like_single_ones(spark, coll, tmp_path, bad):
    coll.insert(docs(1))
    path = _write(tmp_path / "in.jsonl", line(docs(2, 1)[0]) + "\n" + json.dumps({"vector": EAST} | bad))
    with pytest.raises(Exception, match="document ids|primary key|required|expects|scalar|dimension"):
        coll.append_frame(scan_docs(spark, str(path), coll.schema))
    assert coll.stats()["doc_count"] == 1 and coll.insert(docs(2, 1))[0].ok


def test_bulk_rows_keep_extras_and_the_last_counts(spark, coll, tmp_path):
    first, last = docs(1)[0], docs(1)[0]
    last = Doc(last.id, {**last.fields, "rank": 77, "note": "kept", "deep": 3}, last.vector)
    path = _write(tmp_path / "in.jsonl", "\n".join(map(line, [first, *docs(3, 1), last])))
    coll.append_frame(scan_docs(spark, str(path), coll.schema))
    assert coll.stats()["doc_count"] == 3 and coll.fetch(["item-1"])["item-1"].fields == last.fields


def _write(path, text):
    path.write_text(text)
    return path


def test_command_line(spark, tmp_path, capsys):
    def run(*argv):
        cli.run(spark, ["--root", str(tmp_path / "db"), *argv])
        return json.loads(capsys.readouterr().out)

    run("init")
    assert run("create", "docs", "4", "--segment-max-docs", "2")["primary_key"] == "pk"
    path = str(_write(tmp_path / "d.jsonl", "\n".join(map(line, docs(4)))))
    assert [r["status"]["code"] for r in run("insert-jsonl", "docs", path)] == ["Ok"] * 4
    with pytest.raises(cli.Failed):
        run("insert-jsonl", "docs", path)
    capsys.readouterr()
    hits = run("query", "vector", "docs", "--value", "0,0,1.5,2", "--top-k", "1", "--filter", "rank >= 2")
    assert hits[0]["id"] == "item-2" and hits[0]["fields"]["rank"] == {"Int64": 2}
    assert run("query", "by-id", "docs", "--value", "item-3", "--fields", "rank")[0]["fields"] == {"rank": {"Int64": 3}}
    run("create-index", "docs", "embedding", "ivf", "--n-list", "2", "--n-probe", "1")
    assert run("schema", "docs")["vector"]["indexes"]["ivf"]["n_list"] == 2
    assert run("query", "vector", "docs", "--value", "0,0,1.5,2", "ivf", "--nprobe", "1")[0]["id"] == "item-1"
    run("drop-index", "docs", "embedding", "ivf")
    run("add-column", "docs", "flag", "--type", "bool", "--nullability", "nullable")
    assert run("fetch", "docs", "item-1")["item-1"]["fields"]["flag"] == "Null"
    run("rename-column", "docs", "flag", "mark")
    run("drop-column", "docs", "mark")
    run("delete-ids", "docs", "item-1")
    run("delete-filter", "docs", "--filter", "rank = 2")
    run("flush", "docs")
    run("optimize", "docs")
    assert run("stats", "docs")["doc_count"] == 2 and run("options", "docs")["segment_max_docs"] == 2
