"""Exact copies, shards and repeated passages."""

import hashlib
import string
import zlib
from collections import Counter, defaultdict

import xxhash
from odd_tables import ROWS, rows_of
from skillgrid.llm import exact_dedup, line_dedup
from skillgrid.llm.sharding import ShardTree, shard_documents
from skillgrid.session import stored

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def normal(text):
    return (text or "").translate(LOWER)


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        seen = False
        for i in ids:
            stays = i == keep and not seen
            seen |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_equal_brute_force(odd_docs):
    for block in (3, 4096):  # many levels of pairs, and one block per text
        assert rows_of(exact_dedup.exact_groups(odd_docs, block_chars=block)) == brute_groups(ROWS)


def test_exact_groups_tell_odd_tails_apart(spark):
    texts = ["abc", "abcabc", "abcabcabc", "abcabcabcabc", "abcabcabcab", "abcabcabc", "bcabcabca"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = rows_of(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), block_chars=3))
    assert got == brute_groups(rows)


def test_exact_groups_with_a_hot_text(spark):
    rows = [(i, "copy " * 50 if i % 3 else f"text {i}") for i in range(3000)]
    got = rows_of(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), block_chars=64))
    assert got == brute_groups(rows)


def test_blocks_may_cut_letters(spark):
    texts = ["é" * 9, "é" * 8 + "è", "日本語" * 5, "aÉb" * 7, "Aéb" * 7, "aÉB" * 7, "x" * 10, "é" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (1, 5, 4096):
        assert rows_of(exact_dedup.exact_groups(docs, block_chars=block)) == brute_groups(list(enumerate(texts)))


def test_no_filter_of_the_scan_lower_cases_texts(spark, odd_docs, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(exact_dedup, "stored", noted)
    exact_dedup.exact_groups(odd_docs)
    lowered = [line for line in plans[0].splitlines() if "translate(" in line]
    assert lowered and not any("Filter" in line for line in lowered)


def test_exact_on_empty_and_clashing_tables(no_docs, clashing_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert rows_of(exact_dedup.exact_groups(clashing_docs)) == brute_groups(ROWS)
    kept = exact_dedup.drop_exact_copies(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert kept.count() == len({normal(r[1]) for r in ROWS})


def u_of(key, level, child):
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
    second = xxhash.xxh64_intdigest(level.encode(), first)
    bits = xxhash.xxh64_intdigest(child.to_bytes(4, "little", signed=True), second) >> 12
    return (bits + 0.5) / 2 ** 52


def brute_shard(key, tree):
    import math

    regions, racks, shards = tree.levels()
    at = 0
    for level, children in (("region", regions), ("rack", racks), ("shard", shards)):
        listed = children if level == "region" else children[at]
        at = min((-math.log(u_of(key, level, c)) / w, c) for c, w in listed if w > 0)[1]
    return at


def test_shards_equal_brute_force(odd_docs, clashing_docs):
    tree = ShardTree.regular(2, 3, 4)
    got = shard_documents(odd_docs, tree).collect()
    for r in got:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, tree), brute_shard(r.doc_id, tree.with_shard()))
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(clashing_docs, tree).count() == len(ROWS)


def test_shards_follow_weights_and_move_only_into_a_new_shard(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    tree = ShardTree((((1.0, 3.0), (0.0,)), ((2.0,), (2.0,))))
    got = shard_documents(docs, tree).collect()
    counts = Counter(r.shard for r in got)
    assert counts[2] == 0
    for shard, weight in ((0, 1), (1, 3), (3, 2), (4, 2)):
        assert abs(counts[shard] / 20000 - weight / 8) < 0.02
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    assert abs(sum(r.grown_shard == 5 for r in got) / 20000 - 1 / 9) < 0.02


def test_slots_over_several_pieces(spark):
    from skillgrid.llm.sharding import numbered

    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS k")
    got = numbered(df, "g", "k", "n", piece_rows=50).collect()
    for g in range(3):
        assert sorted(r.n for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_shards_of_an_empty_table(no_docs):
    assert shard_documents(no_docs, ShardTree.regular()).count() == 0


PASSAGE = "\n".join(f"shared line {i} with some words" for i in range(30))


def test_repeated_passages_leave_all_but_the_first(spark):
    rows = [(i, f"own head {i}\n{PASSAGE}\nown tail {i}\nlast {i * 7}") for i in range(40)]
    rows += [(100 + i, f"clean {i}\nnothing shared {i}\nend {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(docs).collect()}
    assert got[0].removed_lines == 0 and got[0].text == rows[0][1]
    for i in range(1, 40):
        assert got[i].removed_lines >= 20
        assert got[i].text.startswith(f"own head {i}\n") and f"own tail {i}" in got[i].text
        assert got[i].n_lines - got[i].removed_lines == got[i].text.count("\n") + 1
    assert all(got[i].removed_chunks == 0 and got[i].text == t for i, t in rows[40:])


def test_a_repeated_long_line_is_a_passage(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(i, f"head {i}\n{passage}\ntail {i}") for i in range(5)] + [(9, f"head\n{passage[:-1]}\nshort\nother")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_chunks(docs).collect()}
    assert got == {0: rows[0][1], **{i: f"head {i}\ntail {i}" for i in range(1, 5)}, 9: rows[-1][1]}


def test_line_dedup_on_odd_tables(odd_docs, no_docs, clashing_docs):
    got = line_dedup.remove_repeated_chunks(odd_docs)
    assert got.count() == len(ROWS)
    assert {r.doc_id: r.text for r in got.where("doc_id IN (3, 4)").collect()} == {3: "", 4: ""}
    assert line_dedup.remove_repeated_chunks(no_docs).count() == 0
    assert rows_of(line_dedup.remove_repeated_chunks(clashing_docs)) == rows_of(got)


def test_passages_go_whole_whatever_stands_around_them(spark):
    for size in (2, 3, 5):
        passage = [" ".join(f"p{size}l{line}w{w}" for w in range(60 // size)) for line in range(size)]
        rows = []
        for i in range(12):
            head, tail = [f"head {size} {i} {j}" for j in range(i % 4)], [f"tail {size} {i} {j}" for j in range(i % 3)]
            rows.append((i, "\n".join([*head, *passage, *tail]), "\n".join([*head, *tail])))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
        got = {r.doc_id: r for r in line_dedup.remove_repeated_passages(docs).collect()}
        assert (got[0].removed_lines, got[0].text) == (0, rows[0][1])
        for i, _, left in rows[1:]:
            assert (got[i].text, got[i].removed_lines, got[i].removed_passages) == (left, size, 1)


def test_short_lines_stay_and_rows_of_equal_lines(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "a\nb\nc"), (2, "x\nb\ny"), (3, "q\nq\nq"), (4, "r\nr\nr\nr"), (5, f"k\n{long}"), (6, f"{long}\nm"),
            (7, "\n\ns"), (8, "\n\nt"), (9, "c2\nb\nc\nd2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(docs).collect()}
    assert got == {**dict(rows), 4: "r\nr", 6: "m", 9: "c2\nd2"}


def test_passages_on_odd_tables(odd_docs, no_docs, clashing_docs):
    got = line_dedup.remove_repeated_passages(odd_docs)
    assert got.count() == len(ROWS)
    assert {r.doc_id: r.text for r in got.where("doc_id IN (3, 4)").collect()} == {3: "", 4: ""}
    assert line_dedup.remove_repeated_passages(no_docs).count() == 0
    assert rows_of(line_dedup.remove_repeated_passages(clashing_docs)) == rows_of(got)


def test_passages_match_sql(spark):
    from check import compare, connect

    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "repeated_passages") is None
