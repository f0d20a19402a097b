"""Large-file readers against the whole-file readers, over blocks of 1,500 bytes."""

import collections
import json
import random

import pytest

from loomcast.sources import large, readers

ODD = ['a', '', ' ', '"x"', '"a,b"', '"two\nlines"', '"say ""hi"""', 'l"oose', '"open" tail', '"""', '"\n\n"', 'é', 'x y', '"c;d"', "1", '""']


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1500b", "spark.sql.files.openCostInBytes": "0b"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def bag(df):
    return collections.Counter(tuple(r) for r in df.select("source_id", "format", "rec", "line", "ord", "container", "key", "kind", "text").collect())


def write(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def same(spark, folder, **kw):
    got, want = bag(large.read_csv_files(spark, str(folder), **kw)), bag(readers.read_sources(spark, str(folder), "csv", kw.get("delimiter")))
    strip = lambda c: collections.Counter({(k[0].rsplit("/", 1)[-1], *k[1:]): n for k, n in c.items()})
    assert strip(got) == strip(want)
    assert got == want  # the same names of sources too
    return got


def test_written_cases(spark, tmp_path, small_blocks):
    cases = {
        "plain": "id,name\n" + "".join(f"{i},n{i}\n" for i in range(600)),
        "quoted": 'id,text\n1,"a\nb"\n2,"' + "long line\n" * 700 + '"\n3,c\n\n , \n4,"d ""e"" f"\n',
        "blank_first": "\n \n;;\n", "lead": "\n\nid;v\n1;2\n\n3;4\n",
        "faults": "a,b,,a\n" + "fine,x,,z\n" * 300 + "".join(f"{i},x,y,z,w\n{i}\n" for i in range(12)),
        "short": "a,b\n1\n2,3\n", "no_rows": "a,b\n", "no_rows_blank": "a,b\n , \n\n", "no_names": ",,\n1,2,3\n", "empty": "", "spaces": "  \n\n",
        "nested": "p.q,p > r,s\n1,2,3\n4,5,6\n", "clash": "p.q,p > q\n1,2\n3,4\n", "crlf": "a,b\r\n1,2\r\n3,4\r\n", "cr": "a,b\n1,2\r3\n4,5\n",
        "cp1252": "a,b\n1,caf\xe9 \x93q\x94\n".encode("latin-1"), "latin": b"a,b\n1,\x81\xe9\n", "bom": b"\xef\xbb\xbfa,b\n1,2\n", "open": 'a,b\n1,"never\nclosed\nat all\n2,3\n' + "x\n" * 2000,
        "tabs": "a\tb\n1\t2,3\n", "tail": "a,b,,\n1,2,,\n3,4,,5\n", "end": "a,b\n1,2",
    }
    for name, data in cases.items():
        write(tmp_path, f"{name}.csv", data)
    got = same(spark, tmp_path)
    assert any("lose or mis-assign" in (k[8] or "") for k in got)


@pytest.mark.parametrize("seed", range(2))
def test_random_files(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    for k in range(3):
        width = rng.randint(1, 3)
        rows = [",".join(rng.choices(ODD, k=width if rng.random() < 0.999 else width + 1)) for _ in range(rng.randint(200, 900))]
        write(tmp_path, f"f{k}.csv", ",".join(f"h{i}" for i in range(width)) + "\n" + "\n".join(rows) + rng.choice(("", "\n")))
    same(spark, tmp_path)


def test_many_tasks_and_long_fields(spark, tmp_path):
    write(tmp_path, "wide.csv", "a,b\n1," + "x" * 140_000 + "\n2,3\n")
    write(tmp_path, "open.csv", 'a,b\n1,"' + ("y" * 100 + "\n") * 20_000)
    write(tmp_path, "fine.csv", 'a,b\n1,"' + ("y" * 100 + "\n") * 1000 + '"\n2,3\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert large.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        got = same(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(k[7] == "source_error" for k in got) == 2


def test_wide_records_over_blocks(spark, tmp_path):
    """Records far longer than the limit of a field, of which no field is: many short fields, quoted and over lines or not."""
    several = "a," + ",".join(f'"{k}\nmore of {k}"' for k in range(30_000))
    plain = "b," + ",".join(str(k) for k in range(30_000))
    header = ",".join(f"h{k}" for k in range(30_001))
    write(tmp_path, "wide.csv", f"{header}\n{several}\n{plain}\n{several}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150k")
    try:
        got = bag(large.read_csv_files(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(got.values()) == 3 * 30_001 and not any(k[7] == "source_error" for k in got)
    assert {k[8] for k in got if k[6] == "h29999"} == {"29998\nmore of 29998", "29998"}


def test_utf16_is_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "a,b\n1,2\n".encode("utf-16"))
    with pytest.raises(readers.SourceProblem):
        large.read_csv_files(spark, str(tmp_path))


def test_json_lines(spark, tmp_path, small_blocks):
    records = [{"a": i, "b": {"c": [1, {"d": "é" * i}]}} for i in range(90)] + [[], 3, {}, {"x.y": 1, "x": {"y": 2}}]
    lines = [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(records)]
    write(tmp_path, "good.jsonl", "\n\n".join(lines) + "\n")
    write(tmp_path, "bad.jsonl", lines[0] + "\n{oops\n" + lines[1] + "\n{again\n")
    write(tmp_path, "empty.jsonl", "\n")
    got = bag(large.read_json_lines(spark, str(tmp_path)))
    write(tmp_path, "good.json", json.dumps(records))
    want = bag(readers.read_sources(spark, str(tmp_path / "good.json")))
    assert {k[1:]: n for k, n in got.items() if k[0].endswith("good.jsonl")} == {k[1:]: n for k, n in want.items()}
    rest = {k[0].rsplit("/", 1)[-1]: k[8] for k in got if not k[0].endswith("good.jsonl")}
    assert rest["empty.jsonl"] == "source is empty" and rest["bad.jsonl"].startswith("source is not valid JSON: record 2:")


RECORD = "<{t} id='{i}'><name>n{i} &lt; é</name><x>1</x><x>2</x><deep><v>{i}</v></deep></{t}>"


def test_xml_records(spark, tmp_path, small_blocks):
    records = [RECORD.format(t="item", i=i) for i in range(80)]
    forms = {
        "plain": "<?xml version='1.0' encoding='UTF-8'?>\n<root>\n" + "\n".join(records) + "\n</root>\n",
        "names": "<a:root xmlns:a='urn:a' xmlns='urn:b'>" + " <!-- between --> ".join(RECORD.format(t="a:item", i=i) for i in range(40)) + "<a:item/><a:item>leaf</a:item></a:root><!-- end -->",
        "text": "<!-- <item> --><root>stray" + "".join(records[:30]) + "<item/><item a='1'/>" + "".join(records[30:40]) + "</root>",
    }
    for name, data in forms.items():
        write(tmp_path, f"{name}.xml", data)
        path = str(tmp_path / f"{name}.xml")
        assert large.lines_of(spark, path).rdd.getNumPartitions() > 3
        assert bag(large.read_xml_records(spark, path)) == bag(readers.read_sources(spark, path))
    for name, data in {
        "attributes": f"<root v='1'>{''.join(records)}</root>", "several": f"<root>{''.join(records)}<other/></root>", "nested": "<root><item><item>1</item></item><item>2</item></root>",
        "doctype": f"<!DOCTYPE root><root>{''.join(records)}</root>", "one": f"<root>{records[0]}</root>", "broken": f"<root>{''.join(records)}<item></root>", "none": "<root/>", "cut": f"<root>{''.join(records)}",
        "cdata": f"<root><item><![CDATA[</item>]]></item>{''.join(records)}</root>",
    }.items():
        write(tmp_path, f"{name}.xml", data)
        try:
            large.read_xml_records(spark, str(tmp_path / f"{name}.xml"))
            pytest.fail(name)
        except large.NotByRecord:
            pass
        got = bag(large.read_paths(spark, str(tmp_path / f"{name}.xml"), large=10))
        assert got == bag(readers.read_sources(spark, str(tmp_path / f"{name}.xml")))


def test_read_paths_chooses(spark, tmp_path):
    write(tmp_path, "a.csv", "a,b\n" + "1,2\n" * 50)
    write(tmp_path, "b.json", '[{"a": 1}]')
    write(tmp_path, "c.jsonl", '{"a": 1}\n{"a": 2}\n')
    write(tmp_path, "d.xml", "<r><i><a>1</a></i><i><a>2</a></i></r>")
    write(tmp_path, "e.csv", "a,b\n1,2\n".encode("utf-16"))
    small, big = (bag(large.read_paths(spark, str(tmp_path), large=n)) for n in (1 << 20, 5))
    assert small == big and len({k[0] for k in small}) == 5
