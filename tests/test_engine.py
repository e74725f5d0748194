import io
import json
import sys
import threading
import zipfile

import pandas as pd
import pytest

from textweave import cli
from textweave.engine import Engine, options_from
from textweave.plans.options import BuildOptions
from textweave.sources import codec, segments
from textweave.sources.archive import converted, read_zips
from textweave.sources.storage import Store
from textweave.sources.jsonl import parse_lines, read_docids, read_jsonl
from textweave.streaming.ingest import ingest_stream

MAGIC = b"TEST"


def words(prefix, n=40):
    return " ".join(f"{prefix}{i}" for i in range(n))


def zipped(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return str(path)


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_records_from_lines(spark):
    lines = ['{"doc_id":"a","text":"t","normalized":false}', '{"doc_id":5,"text":"t"}', '{"doc_id":"b","text":""}', "nonsense", "", '{"doc_id":"c","text":"t","text_is_normalized":"no","normalized":false}',
             '{"doc_id":"d","text":"t","source_name":7}', "[1]", '{"doc_id":"e","text":"' + "x" * (9 << 20) + '"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r.doc_id, r.is_normalized, r.source_name) for r in parse_lines(df).collect()) == [("a", False, ""), ("c", True, ""), ("d", True, "")]
    strict = BuildOptions(strict_text_is_normalized=True)
    assert sorted((r.doc_id, r.is_normalized) for r in parse_lines(df, strict).collect()) == [("a", False), ("c", True), ("d", False)]


def test_segment_life(spark, tmp_path):
    root, corpus = str(tmp_path / "index"), tmp_path / "c.jsonl"
    corpus.write_text("\n".join(json.dumps({"doc_id": f"d{i:03}", "text": words(f"p{i}_", 9 + i)}) for i in range(50)))
    entry = segments.build_segment(spark, read_jsonl(spark, str(corpus)), root, "one", BuildOptions(exact_hashes=True))
    assert entry["stats"] == {"docs": 50, "k9": sum(1 + i for i in range(50)), "k13": 0}
    docs = spark.read.parquet(f"{root}/one/docs")
    assert [(r.did, r.doc_id) for r in docs.orderBy("did").collect()] == [(i, f"d{i:03}") for i in range(50)]
    assert segments.validate_root(spark, root) == {"ok": True, "errors": []}
    with pytest.raises(ValueError, match="exists"):
        segments.build_segment(spark, read_jsonl(spark, str(corpus)), root, "one")
    with pytest.raises(ValueError, match="no valid"):
        segments.build_segment(spark, read_jsonl(spark, str(corpus)).limit(0), root, "empty")
    assert not (tmp_path / "index/empty").exists()
    with pytest.raises(ValueError):
        segments.build_segment(spark, read_jsonl(spark, str(corpus)), root, "..")
    codec.export_segment(spark, root, "one", f"{root}/one.bin", MAGIC)
    assert (tmp_path / "index/one.bin").stat().st_size == 28 + 50 * 20 + entry["stats"]["k9"] * 16
    postings, meta = codec.import_segment(spark, f"{root}/one.bin", MAGIC, "one")
    stored = spark.read.parquet(f"{root}/one/postings")
    assert postings.count() == stored.count() and postings.exceptAll(stored.select(postings.columns)).count() == 0
    assert meta.exceptAll(docs.select(meta.columns)).count() == 0
    data = codec.encode(docs.toPandas(), stored.toPandas(), MAGIC)
    assert data == (tmp_path / "index/one.bin").read_bytes()
    with pytest.raises(ValueError):
        codec.read_header(data, b"ELSE")
    assert segments.validate_root(spark, str(tmp_path / "none"))["ok"] is False
    Store(spark).write(f"{root}/manifest.json", "{broken")
    assert segments.load_manifest(spark, root) == []


def test_unsorted_postings_are_found(spark, tmp_path):
    from textweave.operators.validate import unsorted_rows

    rows = pd.DataFrame({"segment": "s", "h": [-1, 5], "did": [0, 0], "pos": [0, 1]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "bad"))  # -1 is the largest unsigned value
    assert unsorted_rows(spark.read.parquet(str(tmp_path / "bad"))) == 1
    for k, hashes in enumerate(([1, 5], [3, 9], [10, 11])):  # each sorted, but the second begins within the first
        spark.createDataFrame(pd.DataFrame({"segment": "s", "h": hashes, "did": 0, "pos": 0})).coalesce(1).write.parquet(str(tmp_path / f"files/{k}"))
    assert unsorted_rows(spark.read.parquet(*[str(tmp_path / f"files/{k}") for k in range(3)])) == 1


def test_writers_of_a_manifest_take_turns(spark, tmp_path):
    root = str(tmp_path / "index")
    with Store(spark).locked(f"{root}/x.lock"), pytest.raises(TimeoutError), Store(spark).locked(f"{root}/x.lock", wait_s=0.2):
        pass
    threads = [threading.Thread(target=segments.append_manifest, args=(spark, root, {"segment_name": f"s{i}", "path": "p"})) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(e["segment_name"] for e in segments.load_manifest(spark, root)) == [f"s{i}" for i in range(8)]


def test_listings_of_both_kinds(spark, tmp_path):
    (tmp_path / "new.json").write_text('[{"doc_id":"a","external_id":"x"},\n7,{"doc_id":7},{"doc_id":"c"}]')
    (tmp_path / "old.json").write_text('["a","b"]')
    assert [(r.did, r.doc_id, r.external_id) for r in read_docids(spark, str(tmp_path / "new.json")).collect()] == [(0, "a", "x"), (3, "c", "")]
    assert [(r.did, r.doc_id, r.meta_path) for r in read_docids(spark, str(tmp_path / "old.json")).collect()] == [(0, "a", ""), (1, "b", "")]


def test_outside_converter():
    command = [sys.executable, "-c", "import sys; open(sys.argv[2], 'w').write(open(sys.argv[1]).read().upper())", "{input}", "{output}"]
    assert converted(b"some words", command) == "SOME WORDS"
    assert converted(b"x", ["/nonexistent"]) is None and converted(b"x", [sys.executable, "-c", "pass"]) is None


def test_engine_life(spark, tmp_path):
    engine, org = Engine(spark, str(tmp_path / "orgs")), "acme"
    a, b = words("a"), words("b")
    path = zipped(tmp_path / "u.zip", {"x/a.TXT": a, "b.docx": docx(b), "old.doc": b"x", "note.md": a, "short.txt": "too short", "cp.txt": (a + " привет").encode("cp1251")})
    told = engine.ingest_zip(org, path)
    assert told["stats"]["docs"] == 3 and told["ingested"] == 4 and [s["external_id"] for s in told["skipped"]] == ["old.doc"]
    listed = {r.external_id: r for r in engine.list_docs(org, 10).collect()}
    assert set(listed) == {"x/a.TXT", "b.docx", "short.txt", "cp.txt"} and all(r.last_segment == told["segment_name"] for r in listed.values())
    hits = engine.search(org, a).collect()
    assert {h.external_id for h in hits} == {"x/a.TXT", "cp.txt"} and hits[0].organization_id == org
    assert json.loads(engine.search_json(org, b))["hits"][0]["C"] == 100.0
    assert engine.validate(org)["ok"]
    assert engine.index_view(org, "b.docx")["index"]["tok_len"] == 40
    assert engine.document_text(org, "cp.txt", max_bytes=11) == {"text": a[:11], "truncated": True}
    with pytest.raises(LookupError):
        engine.index_view(org, "nothing")
    assert engine.delete_doc(org, "x/a.TXT") == engine.delete_doc(org, "x/a.TXT") == engine.delete_doc(org, "unknown") == {"ok": True}
    assert {h.external_id for h in engine.search(org, a).collect()} == {"cp.txt"}
    assert {r.external_id for r in engine.list_docs(org).filter("deleted = 1").collect()} == {"x/a.TXT"}
    with pytest.raises(ValueError):
        engine.ingest_zip(org, zipped(tmp_path / "n.zip", {"note.md": a}))
    with pytest.raises(ValueError):
        engine.search("..", a)
    with pytest.raises(ValueError):
        engine.wipe_org(org, "yes")
    assert engine.wipe_org(org, "WIPE_ORG") and engine.search(org, a) is None


def test_bad_archives_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unsafe"):
        read_zips(spark, zipped(tmp_path / "a.zip", {"../x.txt": "x"})).count()
    with pytest.raises(Exception, match="unpacked"):
        read_zips(spark, zipped(tmp_path / "b.zip", {"x.txt": "x" * 100}), max_bytes=99).count()


def test_request_options():
    assert options_from({"topk": 3, "alpha": 1, "other": "x"}).topk == 3
    for bad in ({"topk": "3"}, {"topk": -1}, {"alpha": "x"}, {"min_hits": True}):
        with pytest.raises(ValueError):
            options_from(bad)


def test_command_line_and_stream(spark, tmp_path, capsys):
    root, source = str(tmp_path / "index"), tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text(json.dumps({"doc_id": "a", "text": words("a")}))
    assert cli.main(["validate", root]) == 2
    assert cli.main(["build", str(source), root, "--segment-name", "s"]) == 0
    capsys.readouterr()
    assert cli.main(["search", root, "--query", words("a").upper().replace(" ", " - ")]) == 0
    assert json.loads(capsys.readouterr().out)["hits"][0]["doc_id"] == "a"
    ingest_stream(spark, str(source), root, str(tmp_path / "cp")).awaitTermination(120)
    (source / "2.jsonl").write_text(json.dumps({"doc_id": "b", "text": words("b")}))
    ingest_stream(spark, str(source), root, str(tmp_path / "cp")).awaitTermination(120)
    assert [e["segment_name"] for e in segments.load_manifest(spark, root)] == ["s", "stream_0000000000", "stream_0000000001"]
    assert cli.main(["validate", root, "--segment", "stream_0000000001"]) == 0
