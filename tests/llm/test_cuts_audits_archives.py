"""Fill-in-the-middle, the filter audit and WARC archives against brute force, round trips and edge cases."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow.fs as fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshtide.llm import fill_middle, filter_audit, warc

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "a  b \n"), (5, "Ä ö 😀 two\x0bthree\x85four "), (6, "word " * 40_000), (7, "x" * 200_000), (8, "has <P> in it"), (9, "ends in < P"), (10, "<P < S> M>" * 30)]
TEXTS += [(k, " ".join(f"w{j}" for j in range(k % 17))) for k in range(100, 200)]


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(*r, 1, "k", "n", 3) for r in TEXTS], "doc_id long, text string, n int, form string, output string, mask int")


@given(st.sets(st.integers(0, 300_000), max_size=300), st.integers(0, 200_000), st.integers(0, 70_000))
@settings(max_examples=40, deadline=None)
def test_boundary_set_selects(some, start, length):
    offsets = np.array(sorted(some | set(range(start, start + length))), np.int64)
    s = fill_middle.BoundarySet(offsets)
    for k in {0, 1, len(offsets) // 3, len(offsets) // 2, len(offsets) - 1, len(offsets)}:
        if 0 <= k <= len(offsets):
            assert s.select(k) == (offsets[k - 1] if k else 0)


def test_containers_are_the_smallest():
    kinds = [fill_middle.Container.of(np.array(x)).kind for x in (range(0, 100, 3), range(0, 60_000, 2), range(50_000), range(0, 60_000, 20))]
    assert kinds == ["array", "bitmap", "run", "array"]
    mixed = fill_middle.BoundarySet(np.concatenate([np.arange(0, 60_000, 2), np.arange(65_536, 130_000), np.arange(200_000, 200_400, 7)]).astype(np.int64))
    assert [c.kind for c in mixed.containers] == ["bitmap", "run", "array"]
    assert {c.kind for c in fill_middle.boundaries("y" * 70_000, "char").containers} == {"run"}


@given(st.text(alphabet=" \t\n\x0b\x1c\x85aÄ😀<P>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_boundaries_are_the_units_ends(text):
    ends = [m.end() for m in UNIT.finditer(text)]
    s = fill_middle.boundaries(text)
    assert [s.select(k) for k in range(s.size + 1)] == [0, *ends]


def brute_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_brute_force(texts):
    got = fill_middle.transformed(texts).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = sorted((repr((i, *brute_cut(i, t), t or "")) for i, t in TEXTS))
    assert sorted(repr((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"])) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.transformed(texts.limit(0)).count() == 0
    every = fill_middle.transformed(texts, unit="char", rate=100).withColumn("back", fill_middle.restored(F.col("form"), F.col("output")))
    assert sorted(r["back"] for r in every.collect()) == sorted(t or "" for _, t in TEXTS)


def test_intervals_are_removal_steps():
    for mask in range(32):
        found = filter_audit.intervals(mask)
        for rank, order in enumerate(permutations(range(5))):
            want = next(((k + 1, f) for k, f in enumerate(order) if mask >> f & 1), None)
            assert [(s, f) for s, f, a, b in found if a <= rank < b] == ([want] if want else [])
    assert filter_audit.orders() == ["".join(p) for p in permutations("ABCDE")]


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    seen = {}
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > seen[t])
        rows.append((part or "", "".join(f for f, x in zip("ABCDE", fails, strict=True) if x), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        here, total = [r for r in rows if r[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] = total.get(f, 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in here) - len(gone), sum(r[1] == f for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_filter_audit_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [*("abcdefgh" * 9), "BIG", "#tag"]
    docs = [(int(k), " ".join(f"{words[rng.integers(70 if k % 4 else 74)]}{rng.integers(200 if k % 3 else 12)}" for _ in range(rng.integers(40, 70))), ["web", "news", None, ""][rng.integers(4)]) for k in range(120)]
    docs += [(200 + k, docs[k % 5][1], "web" if k % 2 else "news") for k in range(40)]  # copies
    docs += [(0, docs[0][1], docs[0][2])] * 2 + [(None, docs[1][1], "news"), (None, "only null ids", "web"), (None, "only null ids", "web"), (300, None, "web"), (301, "", None), (302, " \n ", "web"), (303, "w " * 100_000, "long")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 240, 2)] + [(3, None, 1), (3, 1, None), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 9, "s", 1) for r in docs], "doc_id long, text string, source string, mask int, same string, n int")
    lab = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")
    counts = filter_audit.mask_counts(d, lab)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(counts).collect()}
    want = brute_audit(docs, [(i, *x) for i, *x in labels if i is not None])
    assert got == want and len(got) == 600 * 4
    assert filter_audit.audit(filter_audit.mask_counts(d.limit(0), lab)).count() == 0
    assert sum(r["n"] for r in filter_audit.mask_counts(d, lab.limit(0)).collect()) == len(docs)


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://b/9", "<p>one</p>"), (9, "http://b/9", "<p>one</p>"), (3, None, None), (4, "", ""), (None, "http://c/\r\nX-Evil: 1", "<p>one</p>"),
         (5, "http://d/ü ü", "Ä\r\n\r\nWARC/1.1\r\n" * 3), (6, "http://e", "z" * 300_000), (None, "http://f", "lonely"), (None, "http://f", "lonely")]
PAGES += [(k, f"http://h{k % 3}/{k}", f"<p>page {k % 7 if k % 5 == 0 else k}</p>" * 9) for k in range(100, 160)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "f", 2) for r in PAGES], "page_id long, url string, html string, salt int, file string, offset int")


def brute_archive(folder):
    """Every record, read without the index: gzip members one after the other."""
    disk, root = fs.FileSystem.from_uri(folder)
    found = {}
    for info in disk.get_file_info(fs.FileSelector(root)):
        data, at = disk.open_input_file(info.path).read(), 0
        while data:
            d = zlib.decompressobj(31)
            raw = d.decompress(data)
            size = len(data) - len(d.unused_data)
            found[info.base_name, at, size] = raw
            data, at = d.unused_data, at + size
    return found


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_archives_round_trip(spark, pages, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        folder, index = warc.write_archives(pages, archive_bytes=4000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    places = {(r["file"], r["offset"], r["length"]): r for r in index.collect()}
    stored = brute_archive(folder)
    records = {k: v for k, v in stored.items() if b"WARC-Type: warcinfo" not in v}
    assert set(records) == set(places) and len(places) == len(PAGES) and len({f for f, *_ in places}) > 3
    assert len(stored) - len(records) == len({f for f, *_ in places})
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    read = warc.read_records(folder, index).collect()
    assert all(r["intact"] for r in read)
    got = sorted((r["page"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"] or "", (r["payload"] or b"").decode()) for r in read)
    want = []
    for i, _, h in PAGES:
        h = h or ""
        again = best[h] >= 0 and i != best[h]
        want.append(("none" if i is None else str(i), "revisit" if again else "response", len(h.encode()), warc.sha1_base32(h.encode()), str(best[h]) if again else "", "" if again else h))
    assert got == sorted(want)
    assert sorted(r["url"] or "" for r in places.values()) == sorted(u or "" for _, u, _ in PAGES)
    assert [r["target"] for r in read if r["target"] and "Evil" in r["target"]] == ["http://c/%0D%0AX-Evil:%201"]


def test_reads_are_ranged_and_few(spark, pages):
    folder, index = warc.write_archives(pages.coalesce(1))
    assert warc.read_records(folder, index).agg(F.sum("reads")).first()[0] == 1
    some = index.where(F.col("id").isin(100, 159))
    r = warc.read_records(folder, some, gap=0).collect()
    assert {x["page"] for x in r} == {"100", "159"} and sum(x["reads"] for x in r) == 2
    assert warc.read_records(folder, index.limit(0)).count() == 0
    assert [x[:3] for x in warc.ranges([("a", 0, 5), ("a", 5, 5), ("a", 20, 5), ("b", 20, 1), ("b", 21, 100)], gap=9, most=50)] == [("a", 0, 10), ("a", 20, 25), ("b", 20, 21), ("b", 21, 121)]
    small = warc.write_archives(pages, min_bytes=11)[1]
    assert small.where("record_type = 'revisit'").join(pages.select(F.col("page_id").alias("id"), "html"), "id").where("length(html) < 11").count() == 0
    assert warc.write_archives(pages.limit(0))[1].count() == 0


def test_a_changed_payload_is_seen(spark):
    one = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    folder, index = warc.write_archives(one)
    disk, root = fs.FileSystem.from_uri(folder)
    r = index.first()
    whole = disk.open_input_file(f"{root}/{r['file']}").read()
    bad = zlib.decompress(whole[r["offset"] : r["offset"] + r["length"]], 31).replace(b"abc", b"abd")
    press = zlib.compressobj(wbits=31)
    member = press.compress(bad) + press.flush()
    with disk.open_output_stream(f"{root}/{r['file']}", compression=None) as f:
        f.write(whole[: r["offset"]] + member)
    back = warc.read_records(folder, index.withColumn("length", F.lit(len(member)).cast("long"))).first()
    assert not back["intact"] and back["payload"] == b"abd"
