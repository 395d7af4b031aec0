"""Exact dedup, line dedup and SimHash beside plain versions."""

import hashlib
import random


import numpy as np
import pytest
import xxhash
from helpers import ASCII, HARD, WORD, documents, prose, stored
from pyspark.sql import functions as F

from tidewatch.llm import common, golay, line_dedup
from tidewatch.llm.components import components
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.simhash import _spanning, _verify, fingerprint, fingerprint_links, simhash_groups


# -- exact -------------------------------------------------------------------------------------

@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups_keep_the_largest_id(spark, tmp_path, clash):
    docs = stored(spark, documents(spark, HARD, clash), tmp_path / "d")
    rows = exact_dedup(docs).collect()
    groups = {}
    for doc, text, *_ in HARD:
        groups.setdefault((text or "").translate(ASCII), []).append(doc)
    want = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, top, len(ids), sha) for i in ids]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=key) == sorted(want, key=key)
    for text in groups:                      # one row of each group stays, repeated rows too
        sha = hashlib.sha256(text.encode()).hexdigest()
        assert sum(r.kept for r in rows if r.text_sha256 == sha) == 1
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_with_a_hot_group_and_odd_trees(spark, tmp_path):
    docs = stored(spark, documents(spark, [(i, "same" if i % 3 else f"own {i}") for i in range(300)], partitions=7), tmp_path / "d")
    for runs, fan_in in ((1, 2), (5, 2), (64, 4)):
        rows = exact_dedup(docs, runs, fan_in).collect()
        assert len(rows) == 300 and sum(r.kept for r in rows) == 101
        assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3} == {(299, 200)}
    with pytest.raises(ValueError):
        exact_dedup(docs, 0)


def test_exact_empty(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


# -- lines -------------------------------------------------------------------------------------

def near(a, b):
    """One word replaced, inserted or dropped; the longer of five words or more."""
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_lines(rows):
    """Lines to drop, by brute force over all pairs of lines."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    before, out = [], {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")          # a null text is one empty line, as in the query's SQL
        left, equal, close = [], 0, 0
        for line in lines:
            words = WORD.findall(line)
            if not words:
                left.append(line)
                continue
            if words in before:
                equal += 1
            elif any(near(words, other) for other in before):
                close += 1
            else:
                left.append(line)
            before.append(words)
        out[i] = (None if rows[i][1] is None else "\n".join(left), len(lines), equal + close, close)
    return out


def check_lines(spark, rows, path, clash=False):
    docs = stored(spark, documents(spark, rows, clash, partitions=0).coalesce(1), path)
    want = plain_lines(rows)
    got = dedup_lines(docs).select("doc_id", "text", "lines.*").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.text, r.all, r.dropped, r.near) for r in got), key=key) == sorted(
        ((rows[i][0], *want[i]) for i in want), key=key)


def test_lines_beside_brute_force(spark, tmp_path):
    draw = random.Random(4)
    lines = [prose(i, draw.randint(1, 9)) for i in range(40)]

    def edited(line):
        words = line.split()
        i = draw.randrange(len(words))
        kind = draw.randrange(4)
        if kind == 0:
            words[i] = "changed"
        elif kind == 1:
            words.insert(i, "more")
        elif kind == 2 and len(words) > 1:
            del words[i]
        return ("  " if kind == 3 else " ").join(words)

    rows = [(i, "\n".join(edited(draw.choice(lines)) if draw.random() < 0.7 else draw.choice(["", " ", prose(900 + i, 12)])
                          for _ in range(draw.randint(0, 6)))) for i in range(40)]
    check_lines(spark, rows, tmp_path / "d")


@pytest.mark.parametrize("clash", [False, True])
def test_lines_of_hard_rows(spark, tmp_path, clash):
    check_lines(spark, HARD, tmp_path / "d", clash)


def test_a_line_with_one_varying_word_many_times(spark, tmp_path):
    rows = [(i, f"page {i} of the annual report on mills") for i in range(300)] + [(1000, prose(5, 400))]
    check_lines(spark, rows, tmp_path / "d")


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("vocabulary", [6, 4000])
def test_lines_within_a_share_of_edits(spark, tmp_path, vocabulary):
    draw = random.Random(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    rows, bases = [], [[draw.choice(words) for _ in range(draw.randint(3, 60))] for _ in range(25)]
    for i in range(60):
        lines = []
        for _ in range(draw.randint(1, 5)):
            line = list(draw.choice(bases))
            for _ in range(draw.randint(0, len(line) // 3)):
                at, kind = draw.randrange(len(line)), draw.randrange(3)
                line[at:at + (kind != 1)] = [draw.choice(words)] * (kind != 2)
                line = line or ["w0"]
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(None, rows[3][1]), (70, rows[5][1] + "\n\n" + rows[6][1])]
    docs = stored(spark, documents(spark, rows, partitions=0).coalesce(1), tmp_path / "d")
    before, want, edits = [], {}, set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        left = []
        for line in text.split("\n"):
            w = line.split()
            near = [k for b in before if (k := word_distance(w, b)) <= max(len(w), len(b)) // 5]
            edits.update([min(near, default=0)])
            if not w or not near:
                left.append(line)
            if w:
                before.append(w)
        want[doc] = "\n".join(left)
    assert {r.doc_id: r.text for r in dedup_lines(docs, per_edit=5).collect()} == want
    assert max(edits) > 1
    with pytest.raises(ValueError):
        dedup_lines(docs, per_edit=4)


def test_lines_keep_other_columns(spark, tmp_path):
    docs = stored(spark, documents(spark, [(1, "a b\nc", "en", "s"), (2, "a b\nd", None, "t")], True), tmp_path / "d")
    got = {r.doc_id: r for r in dedup_lines(docs, docs.columns).collect()}
    assert got[2].text == "d" and got[2].source == "t" and got[1].text == "a b\nc" and got[1]["_row"] is not None
    with pytest.raises(ValueError):
        dedup_lines(docs.withColumn("lines", F.lit(1)), [*docs.columns, "lines"])


def test_lines_empty(spark):
    assert dedup_lines(documents(spark, [])).count() == 0


# -- SimHash -----------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(ASCII))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                    low = min(label[i], label[j])
                    label = [low if x in (label[i], label[j]) else x for x in label]
                    changed = True
    return label


def test_fingerprints():
    for _, text, *_ in HARD:
        assert fingerprint(text) == plain_fingerprint(text)


def test_golay_code():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    assert len(set(golay.decode(words).tolist())) <= 1 << 12
    numbers = {int(n) for n in golay.decode(np.arange(1 << 23, dtype=np.int64)[::997])}
    assert max(numbers) < 1 << 12
    single, errors = golay._tables()
    assert (errors[1:] > 0).all() and len(set(errors.tolist())) == 1 << 11      # perfect: each remainder once


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    base[0] = 0
    other = base.copy()
    for i in range(len(base)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1 << int(b))
    k1, o1 = golay.keys(base)
    k2, o2 = golay.keys(other)
    first = {}
    for k, o in zip(k1.tolist(), o1.tolist()):
        first.setdefault(o, set()).add(k)
    met = {o for k, o in zip(k2.tolist(), o2.tolist()) if k in first[o]}
    assert len(met) == len(base)


@pytest.mark.parametrize("clash", [False, True])
def test_simhash_of_hard_rows(spark, tmp_path, clash):
    docs = stored(spark, documents(spark, HARD, clash, partitions=0).coalesce(1), tmp_path / "d")
    fps = [plain_fingerprint(r[1]) for r in HARD]
    label = plain_components(fps)
    key = lambda r: tuple(str(x) for x in r)
    want = []
    for i, row in enumerate(HARD):
        ids = [HARD[j][0] for j in range(len(HARD)) if label[j] == label[i] and HARD[j][0] is not None]
        want.append((row[0], f"{fps[i]:016x}", min(ids, default=None), label.count(label[i])))
    got = simhash_groups(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id, r.group_size) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.is_kept for r in got) == len(set(label))


def test_links_connect_what_brute_force_does(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for s in seeds:                           # chains and dense clusters
        x = int(s)
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
            if rng.random() < 0.4:
                x = int(s)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    want = plain_components(fps)
    for chunk in (4096, 8):                   # 8: long keys are cut and compared in pairs of chunks
        roots = {r.node: r.root for r in components(fingerprint_links(df, chunk=chunk)).collect()}
        signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
        got = [roots.get(s, s) for s in signed]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_long_runs_are_cut_into_chunks():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key = np.sort(rng.choice([1, 1, 1, 2, 3], 200)).astype(np.int64)
    fp = rng.integers(0, 1 << 40, 200).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + 30]), pa.array(fp[i:i + 30])], names=["key", "fp"])
               for i in range(0, 200, 30)]
    out = pa.Table.from_batches(list(_verify(4, 16, few=4)(iter(batches)))).to_pandas()
    cut = out[out["part"].notna()]
    for k in set(cut["a"]):                   # a key that is cut is cut as a whole
        assert sorted(cut[cut["a"] == k]["b"]) == sorted(fp[key == k])
        assert cut[cut["a"] == k].groupby("part").size().max() <= 46
    assert set(cut["a"]) == {1, 2, 3} & {k for k in (1, 2, 3) if (key == k).sum() > 46} | set(cut["a"])


def test_spanning_forest_is_linear():
    fps = (np.uint64(0xABCDEF) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64)))
    assert sum(len(b) for _, b in _spanning(fps, 4)) == len(fps) - 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    draw = random.Random(1)
    draw.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_empty(spark):
    assert simhash_groups(documents(spark, [])).count() == 0


def test_lines_equal_their_sql_on_hard_rows(spark):
    """Null, empty and very long texts as the query's SQL has them; ids once, as it merges by id."""
    import duckdb

    from tidewatch.llm.queries import LLM_ORACLES

    rows = list({r[0]: r for r in HARD if r[0] is not None}.values()) + [(20, "one two three four five\n\nmill"), (21, "one two four five")]
    documents_ = documents(spark, rows)
    got = dedup_lines(documents_).select("doc_id", "lines.all", "lines.dropped", "lines.near",
                                         F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, got)) == sorted(con.execute(LLM_ORACLES["op1_line_dedup"]).fetchall())


def test_kept_columns_may_have_any_name(spark):
    names = ["_row", "_gone", "_kept", "_left", "h1", "line"]
    docs = documents(spark, [(1, "a b"), (2, "a b"), (3, None)])
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names if n not in docs.columns])
    got = {r["doc_id"]: r for r in dedup_lines(docs, ["doc_id", *names]).collect()}
    assert [got[1][n] for n in names] == [f"{n}-1" for n in names] and got[2]["text"] == "" and got[3]["text"] is None


def test_lines_longer_than_a_key_tells(spark):
    """Of a line of over ``LONG`` words neither length nor place goes with its keys."""
    long = [f"w{i}" for i in range(line_dedup.LONG + 500)]
    edited = ["x" if i % 7 == 0 else w for i, w in enumerate(long)]
    other = ["x" if i % 4 == 0 else w for i, w in enumerate(long)]
    shorter = edited[:line_dedup.LONG - 100]
    rows = [(i, " ".join(words)) for i, words in enumerate([long, edited, other, shorter])]
    found = line_dedup.dedup_lines(documents(spark, rows), per_edit=5).collect()
    assert {r.doc_id: r.lines.near for r in found} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_candidate_lines_are_stored_as_texts(spark, monkeypatch):
    """Lists of words and unused digests took more disk than the lines."""
    put, kinds = line_dedup.written, {}

    def write(df, name):
        kinds[name] = dict(df.dtypes)
        return put(df, name)

    monkeypatch.setattr(line_dedup, "written", write)
    rows = [(i, f"{prose(1, 12)} {i}") for i in range(4)]
    found = line_dedup.dedup_lines(documents(spark, rows), per_edit=5).collect()
    assert {r.doc_id: r.lines.near for r in found} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert set(kinds["line-candidates"]) == {"no", "first", "s"} and kinds["line-candidates"]["s"] == "string"


def test_lines_meet_in_parts_and_their_tables_go(spark, monkeypatch):
    """One join shuffled all candidate lines at once, and their tables stayed until the stage had ended."""
    put, made = line_dedup.written, []

    def write(df, name):
        out = put(df, name)
        made.append((name, out))
        return out

    monkeypatch.setattr(line_dedup, "written", write)
    rows = [(i, f"{prose(i // 3, 12)} {'x ' * (i % 3)}{i}\n{prose(i // 4, 15)}") for i in range(60)]
    seen = []
    for most in (100_000, 4):
        made.clear()
        seen.append(sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(spark, rows), most=most, per_edit=5).collect()))
        parts = {n: sum(name == n for name, _ in made) for n in ("line-candidates", "line-near-words", "line-near", "line-shared")}
        assert set(parts.values()) == {1 if most == 100_000 else line_dedup.PARTS}
    assert seen[0] == seen[1] and sum(len(text) for _, text in seen[0]) < sum(len(text) for _, text in rows) / 2
    for name, table in made:
        if name in ("line-candidates", "line-met", "line-shared", "line-near-words"):
            with pytest.raises(Exception, match="not exist|NOT_EXIST"):
                table.count()


def test_tables_written_alone_are_compressed(spark):
    names = []

    def make():
        names.extend(common.written(spark.range(10), "inner").inputFiles())
        return spark.range(5)

    names.extend(common.alone("outer", make).inputFiles())
    assert names and all(".zstd." in name for name in names)
