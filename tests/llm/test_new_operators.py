"""Alignment, conversation repair and packing against brute force, and their defined results on odd tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import ROWS
from pyspark.sql import functions as F

from skillgrid.llm import alignment, conversations, packing
from skillgrid.llm.byte_bpe import byte_bpe
from skillgrid.llm.queries import LLM_QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


# --- ids -----------------------------------------------------------------------------------------------------------

def test_byte_ids_equal_the_library(sample_docs):
    from tokenizers import Tokenizer

    tricky = ["<|endoftext|>x <|endoftext|>", "<|ENDOFTEXT|>", "a b  c​  \n\n x", "Straße ½ Ⅷ ²", "'s 'S it's", "\x1c\x85",
              " " * 5000, "x" * 5000, "😀 é", ""]
    texts = tricky + [r["text"] or "" for r in sample_docs.select("text").collect()]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} \n{chr(c)}" for c in range(1, 0x3000, 7)]
    library, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    for special in (True, False):
        library.encode_special_tokens = not special
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in own.encode(texts, special)] == expected


# --- alignment -----------------------------------------------------------------------------------------------------

def aligned_by_hand(rows):
    """Per row the contract's columns, token pair by token pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = byte_bpe(BYTES).token_bytes

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba, bb = [letters[i] for i in ia], [piece(i) for i in ib]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        ea, eb = list(itertools.accumulate(map(len, ba))), list(itertools.accumulate(map(len, bb)))
        both = sorted(set(ea) & set(eb))
        groups = []
        for lo, hi in zip([0, *both], both):
            groups.append(",".join(str(i) for i, e in zip(ia, ea) if lo < e <= hi) + "|"
                          + ",".join(str(i) for i, e in zip(ib, eb) if lo < e <= hi))
        links, j = [], 0
        for i, end in enumerate(ea):
            begin = end - len(ba[i])
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(eb) and eb[k] - len(bb[k]) < end:
                links.append((ia[i], ib[k]))
                k += 1
        counts.update(links)
        found.append((doc_id, len(ia), len(ib), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[p] == highest[p[1]] for p in links),
                    sum(counts[p] for p in links), sha) for d, na, nb, g, links, sha in found), key=repr)


def result(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 20_000, 8 << 20])
def test_alignment_equals_brute_force(spark, sample_docs, block_bytes):
    rows = [tuple(r) for r in sample_docs.select("doc_id", "text").collect()]
    assert result(alignment.align_documents(sample_docs, BYTES, PIECES, block_bytes=block_bytes)) == aligned_by_hand(rows)


def test_alignment_query_is_the_operator(spark, sample_docs):
    assert result(LLM_QUERIES["op11_token_alignment"](spark, FOLDER)) == result(
        alignment.align_documents(sample_docs, BYTES, PIECES))


def test_alignment_of_odd_tables(spark, clashing_docs, no_docs):
    extra = [(20, "a▁b"), (21, "<s> <|endoftext|> <0x41> </s>"), (22, "\x00é́\t😀 ﬁ"), (23, "xxxxxxxxxxxxyxxxxxxx"), (23, "\n\n  \n")]
    rows = [(r[0], r[1]) for r in ROWS] + extra
    docs = clashing_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    assert result(alignment.align_documents(docs, BYTES, PIECES)) == aligned_by_hand(rows)
    assert alignment.align_documents(clashing_docs, BYTES, PIECES).count() == len(ROWS)
    assert alignment.align_documents(no_docs, BYTES, PIECES).count() == 0


def test_shared_cuts_equal_intersection():
    draw = np.random.default_rng(5)
    for size in (1, 2, 5, 40, 300):
        a, b = (np.unique(draw.integers(0, 2 * size, size)) for _ in range(2))
        whole = tuple(np.array([x]) for x in (0, len(a), 0, len(b)))
        i, j = alignment.shared_cuts(a, b, whole)
        assert sorted(a[i].tolist()) == sorted(b[j].tolist()) == np.intersect1d(a, b).tolist()


# --- conversations -------------------------------------------------------------------------------------------------

def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def repaired_by_hand(ids, rows):
    """Every conversation by a search over (cost, whole edit string)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    answers = []
    for conv in set(ids):
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64],
                                hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        blank = duplicate = truncated = 0
        seen, faults = set(), []
        for _, _, role, text in own:
            kept = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "dup" if (role, text) in seen else "cut" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        blank, duplicate, truncated = (faults.count(f) for f in ("blank", "dup", "cut"))
        initials = [r[2][:1] for r in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0

        # (cost, audit, repaired) by state, over all rows; inserts are tried until nothing gets better.
        best = {0: (0, "", ())}

        def put(states, state, way):
            if state not in states or way[:2] < states[state][:2]:
                states[state] = way
                return True
            return False

        def inserts(states):
            again = True
            while again:
                again = False
                for s, (cost, audit, said) in list(states.items()):
                    for role in ("user", "assistant"):
                        if (s, role[0]) in step:
                            again |= put(states, step[s, role[0]], (cost + 2, audit + "I", (*said, f"{role}:")))

        for (_, _, role, text), fault in zip(own, faults):
            inserts(best)
            after = {}
            for s, (cost, audit, said) in best.items():
                put(after, s, (cost + 3, audit + "D", said))
                if fault in ("blank", "dup"):
                    continue
                more = fault == "cut"
                if (s, role[:1]) in step:
                    put(after, step[s, role[:1]], (cost + more, audit + "K", (*said, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (s, new[0]) in step:
                        put(after, step[s, new[0]], (cost + 2 + more, audit + "R", (*said, f"{new}:{text}")))
            best = after
        inserts(best)
        cost, audit, said = min(best[s] for s in (0, 3) if s in best)
        answers.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
                        hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(answers, key=repr)


def answers_of(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_repair_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    expected = repaired_by_hand([r[0] for r in rows], damaged_by_hand(rows))
    assert answers_of(LLM_QUERIES["op12_conversation_repair"](spark, folder)) == expected


def odd_messages(seed, n):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", "  \n", "Why? ", "ok!\n", "a" * 70 + "1.", "a" * 70 + "2.", None]
    roles = ["user", "assistant", "system", "tool", "", "ugly", "User", None]
    return [(draw.choice([1, 2, 3, 4, None]), draw.choice([None, *range(n // 4)]), draw.choice(roles), draw.choice(texts))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_repair_of_odd_and_split_conversations(spark, seed, monkeypatch):
    """Five conversations over many tasks: each is split, with ties, repeated rows and nulls everywhere."""
    monkeypatch.setattr(conversations, "_BLOCK", 7)
    rows = odd_messages(seed, 60 + 40 * seed)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("copies", F.lit(9))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        expected = repaired_by_hand([r[0] for r in rows], damaged_by_hand(rows))
        assert answers_of(conversations.repair_conversations(conversations.damage(table))) == expected
        said = conversations.repaired_messages(conversations.damage(table)).orderBy("conv_id", "place").collect()
        lines = defaultdict(list)
        for r in said:
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {a[0]: a[-1] for a in expected} == {a[0]: hashlib.sha256("\n".join(lines[a[0]]).encode()).hexdigest()
                                                 for a in expected}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repair_of_empty_and_emptied_tables(spark):
    schema = "conv_id string, turn int, role string, text string, present boolean"
    empty = spark.createDataFrame([], schema)
    assert conversations.repair_conversations(empty).count() == 0
    gone = spark.createDataFrame([("x", 1, "user", "Hi.", False)], schema)
    nothing = hashlib.sha256(b"").hexdigest()
    assert answers_of(conversations.repair_conversations(gone)) == [("x", 0, 0, 0, 0, 0, 0, "", nothing)]


def test_all_short_conversations_are_repaired_at_least_cost():
    """Against all edit strings up to the length that could be cheapest."""
    options = [(i, f) for i in "sua" for f in (0, 1, 2)]
    for messages in itertools.chain.from_iterable(itertools.product(options, repeat=n) for n in (0, 1, 2, 3)):
        rows = [(0, i, {"s": "system", "u": "user", "a": "assistant"}[initial], f"{i}{['.', '', 'x'][fault]}")
                for i, (initial, fault) in enumerate(messages)]
        if any(f == 1 for _, f in messages):
            rows = [(c, t, r, "" if messages[t][1] == 1 else x) for c, t, r, x in rows]
        (expected,) = repaired_by_hand([0], rows)
        assert conversations.cheapest_audit(conversations.cheapest_paths(list(messages), ends=True)) == expected[6:8]


def test_edit_strings_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(conversations.EditLog, "_MOD", 3)
    draw = random.Random(1)
    log = conversations.EditLog()
    nodes = [0]
    for _ in range(400):
        nodes.append(log.extend(draw.choice(nodes[-20:]), draw.choice("DIKR")))
    for _ in range(3000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        if log.text(a) != log.text(b):
            assert log.before(a, b) == (log.text(a) < log.text(b))


# --- packing -------------------------------------------------------------------------------------------------------

def check_packing(df, rows, window=2048, end=1):
    """Every id once, sequences without gaps, no padding; returns pieces by sequence."""
    own = byte_bpe(BYTES)
    left = Counter()
    expected = {}
    for doc_id, text in rows:
        ids = np.append(own.encode([text or ""], True)[0], np.uint32(end)).astype("<u4")
        expected.setdefault(doc_id, []).append(ids)
    pieces = [r.asDict() for r in df.collect()]
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        left[p["doc_id"]] += p["length"]
        assert any(len(ids) == p["doc_tokens"] and p["length"] > 0 and
                   zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in expected[p["doc_id"]])
    assert left == Counter({d: sum(map(len, several)) for d, several in expected.items()})
    for doc_id, several in expected.items():
        cuts = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == doc_id)
        if len(several) == 1:
            assert [s for s, _ in cuts] == [0, *itertools.accumulate(n for _, n in cuts)][:-1]
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        held.sort(key=lambda p: p["offset"])
        sizes = [p["length"] for p in held]
        assert [p["offset"] for p in held] == [0, *itertools.accumulate(sizes)][:-1]
        total = sum(sizes)
        assert total == window or (total < window and total & (total - 1) == 0)
    return sequences


def test_packing_query_covers_all_ids(spark, sample_docs):
    rows = [tuple(r) for r in sample_docs.select("doc_id", "text").collect()]
    check_packing(LLM_QUERIES["op13_packing"](spark, FOLDER), rows)


@pytest.mark.parametrize("max_open", [0, 2, 4096])
def test_packing_when_open_windows_are_few(spark, sample_docs, max_open):
    rows = [tuple(r) for r in sample_docs.select("doc_id", "text").collect()]
    df = packing.pack_documents(sample_docs.repartition(3), BYTES, 1, window=300, max_open=max_open)
    sequences = check_packing(df, rows, window=300)
    assert sum(sum(p["length"] for p in held) < 300 for held in sequences.values()) <= 3 * 9


def test_packing_of_odd_tables(spark, clashing_docs, no_docs):
    check_packing(packing.pack_documents(clashing_docs, BYTES, 1), [(r[0], r[1]) for r in ROWS])
    assert packing.pack_documents(no_docs, BYTES, 1).count() == 0


def test_levels_minimise_the_sum_of_squares():
    draw = random.Random(3)
    levels, counts = packing.FillLevels(16), Counter()
    for _ in range(500):
        size = draw.randint(1, 15)

        def after(level):
            moved = Counter(counts)
            if level:
                moved[level] -= 1
            if level + size < 16:
                moved[level + size] += 1
            return sum(n * n for n in moved.values())

        free = [level for level in range(0, 17 - size) if level == 0 or counts[level]]
        best = min(free, key=lambda level: (after(level), -level))
        assert levels.best_level(size) == best
        levels.place((0, 0, np.zeros(size)))
        if best:
            counts[best] -= 1
        if best + size < 16:
            counts[best + size] += 1
