"""Lists of any size, read by several tasks: the same rows and numbers as of a file read whole."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogia.plans import imports
from catalogia.sources import pricelists, splits


def whole(text, delimiter):
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


def test_fields_and_records():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(['"', '"', ";", "\n", "a", "b", '";', '";"', '""', "\r\n"]) for _ in range(rng.randrange(14)))
        assert splits.records_of(text, ";") == ([r or [""] for r in whole(text, ";")] if text else []), text
    assert splits.fields_of('x;"a;b', ";") == (["x", "a;b"], True) and splits.fields_of('c";d', ";", True) == (["c", "d"], False) and splits.fields_of('12" screen;5', ";") == (['12" screen', "5"], False)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_many_splits_of_odd_lists(spark, tmp_path, small_splits):
    rng = random.Random(4)
    cell = lambda: rng.choice(["", "x", "12", "1,5", "2.50", '12" monitor', "plain text", "città", "  ", "a b"])
    quoted = lambda: '"' + rng.choice(["a;b", "two\nlines", 'he said ""no""', "long " * 60, "\n\n", "x\r\ny", "", ";", "q\n" * 90]) + '"'
    files = {}
    for name, d, end, enc in (("a", ";", "\n", "utf-8"), ("b", ",", "\r\n", "utf-8-sig"), ("c", "\t", "\n", "cp1252"), ("d", "|", "\r\n", "utf-8"), ("e", ";", "\n", "utf-16")):
        head = d.join(["Sku", "Prezzo", "Prezzo", ""])
        body = [d.join((quoted() if rng.random() < 0.15 else cell().replace(d, " ")) for _ in range(rng.choice([4, 4, 4, 3, 5]))) for _ in range(260)] + ["", d * 3, "last" + d + "1"]
        files[name] = (d, end.join([head, *body]) + end * rng.randrange(2), enc)
        (tmp_path / f"{name}.csv").write_bytes(files[name][1].encode(enc))
    (tmp_path / "x.xlsx").write_bytes(b"PK\x03\x04" + b"zz\n" * 50)
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = splits.read_lists(spark, str(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.rsplit("/", 1)[1][0], {})[r.row_number] = (r.headers, r["values"])
    assert set(got) == set("abcde")
    for name, (d, text, _) in files.items():
        records = whole(text, d)
        heads = ["Sku", "Prezzo", "Prezzo (2)", "Colonna 4"]
        want = {n: (heads, {h: (rec[j] or None) if j < len(rec) else None for j, h in enumerate(heads)}) for n, rec in enumerate(records[1:], 2) if any(c.strip() for c in rec)}
        assert got[name] == want, name
    told = {r.path.rsplit("/", 1)[1]: r for r in splits.dialects(spark, str(tmp_path)).collect()}
    assert [(told[f"{k}.csv"].encoding, told[f"{k}.csv"].delimiter) for k in "abcd"] == [("utf-8", ";"), ("utf-8", ","), ("windows-1252", "\t"), ("utf-8", "|")] and told["x.xlsx"].error == "xlsx_needs_conversion"
    by_file = splits._lines(spark, str(tmp_path)).groupBy("path").agg(F.count_distinct("block").alias("n")).collect()
    assert max(r.n for r in by_file) > 10


def test_as_the_reader_of_whole_files(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_text("note\nsku;p\n" + "".join(f'{i};"{i}\n{i}"\n' for i in range(300)) + '9;"never closed\n1;2')
    path = splits.dialects(spark, str(tmp_path)).first().path
    config = spark.createDataFrame([(path, None, ";", 2)], "path string, encoding string, delimiter string, header_row int")
    key = lambda df: sorted((r.row_number, tuple(r.headers), tuple(sorted(r["values"].items()))) for r in df.collect())
    new = splits.read_lists(spark, str(tmp_path), config)
    old = pricelists.read_pricelists(pricelists.files(spark, str(tmp_path)).withColumn("path", F.lit(path)), config)
    assert key(new) == key(old) and len(key(new)) == 301


def test_quoted_records_between_others_make_few_batches():
    """Records without quotes between quoted ones went to Spark in a batch for each stretch before."""
    lines = [x for k in range(300) for x in (f"{k};", f'{k};"two', 'lines"', f'"{k}";')]
    n = len(lines)
    batch = pa.RecordBatch.from_pydict({"path": ["a"] * n, "block": [0] * n, "line": [x.encode() for x in lines], "inside": [False] * n, "before": [0] * n, "encoding": ["utf-8"] * n, "delimiter": [";"] * n})
    out = list(splits._numbered(iter([batch])))
    got = sorted((r["row_number"], r["cells"]) for b in out for r in b.to_pylist())
    assert got == [(n, [c or None for c in rec]) for n, rec in enumerate(whole("\n".join(lines), ";"), 1)]
    assert len(out) == 2


def test_lists_of_many_suppliers_are_few_files(spark, tmp_path, monkeypatch):
    """There was a folder and a file for each supplier before; making and opening them took most of the time."""
    d, made = "/root/testdata/sf0.01", str(tmp_path / "lists")
    monkeypatch.setattr(imports, "folder", lambda *_: made)
    got = imports.a1_a2_lists_by_splits(spark, d)
    files = [f for f in tmp_path.glob("lists/**/part-*") if f.is_file()]
    suppliers = got.select("supplier_id").distinct().count()
    assert suppliers == 100 and 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = got.groupBy("supplier_id").agg(F.min("row_number").alias("a"), F.max("row_number").alias("b"), F.count("*").alias("n"), F.count_distinct("row_number").alias("m"))
    assert numbers.filter("a <> 2 or b <> n + 1 or m <> n").count() == 0
