"""Conversation repair, equal shards and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import dialogue, divergence, sharding

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT, INITIAL = {0: 2, 1: 2, 2: 3, 3: 2}, {"s": 1, "u": 2, "a": 3}
ROLE = {2: "user", 3: "assistant"}


def hurt(rows):
    """Rows (conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits, state by state, letters compared as strings."""
    states = {0: (0, "", ())}
    for role, text, fault in [*rows, (None, None, None)]:
        ready = dict(states)
        for _ in range(2):
            for q, (cost, audit, lines) in list(ready.items()):
                put = (cost + 3, audit + "I", (*lines, f"{ROLE[NEXT[q]]}:"))
                ready[NEXT[q]] = min(ready.get(NEXT[q], put), put, key=lambda x: x[:2])
        if role is None:
            return min((ready[q] for q in (0, 3) if q in ready), key=lambda x: x[:2])
        states = {}

        def reach(q, cost, letter, lines):
            found = (cost, letter, lines)
            states[q] = min(states.get(q, found), found, key=lambda x: x[:2])

        for q, (cost, audit, lines) in ready.items():
            reach(q, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if INITIAL.get(role[:1]) == NEXT[q] or (role[:1] == "s" and q == 0):
                reach(INITIAL[role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            reach(NEXT[q], cost + more + 3, audit + "R", (*lines, f"{ROLE[NEXT[q]]}:{text}"))


def report_by_hand(rows):
    """``rows`` of one conversation (turn, role, text) in order."""
    seen, marked = set(), []
    for turn, role, text in rows:
        end = text.rstrip(SPACES)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "fine" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, *_ in rows if t is not None}
    faults = Counter(f for *_, f in marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(marked)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


def talk(draw, conv, n, roles=("system", "user", "assistant", "tool", "", None, "user", "assistant")):
    texts = ["Hello.", "Yes!", "cut off", "  ", "\t\n", "", None, "Why?\n", "a.b", "é。", "Ok. ", "\x00"]
    turns = draw.sample(range(3 * n), n)
    rows = [(conv, t, draw.choice(roles), draw.choice([*texts, f"line {draw.random()}.", f"part {draw.random()}"])) for t in turns]
    return [(c, None if draw.random() < 0.02 else t, r, x) for c, t, r, x in rows]


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(12)
    rows = [row for conv in range(150) for row in talk(draw, conv, draw.randrange(1, 14))]
    rows += talk(draw, None, 9) + talk(draw, 900, 2500)  # one conversation over many partitions
    rows += [(901, i, "user", "again.") for i in range(1200)]  # a long run of equal symbols
    rows += [(902, 5, "user", "same turn."), (902, 5, "assistant", "same turn."), (902, 5, "user", "same turn.")]
    draw.shuffle(rows)
    return rows


def test_repair(spark, talks):
    table = spark.createDataFrame(talks, COLUMNS).repartition(5).selectExpr("*", "'x' as part", "1 as pos", "'y' as fault")
    found = {r.conv_id: tuple(r)[1:] for r in dialogue.repaired_damage(table).collect()}
    texts = sorted({x for *_, x in hurt(talks)})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in hurt(talks):
        groups[conv].append((turn, role, text))
    assert set(found) == {c for c, *_ in talks}
    for conv, got in found.items():
        rows = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashes[r[2]]))
        assert got == report_by_hand(rows), conv
    assert len(found[900][6]) >= 2000 and found[901][2] > 900


def test_repair_of_nothing(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = dialogue.repaired_damage(spark.createDataFrame([(lost, 0, "user", "Gone.")], COLUMNS)).collect()
    assert [tuple(r) for r in rows] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogue.repaired_damage(spark.createDataFrame([], COLUMNS)).count() == 0


def test_powers_are_those_of_single_rows():
    for of in [("s", "fine"), ("u", "truncated"), ("", "blank"), ("a", "fine")]:
        one, by_rows = dialogue.row_matrix(of), dialogue.LAST
        for n in range(1, 40):
            by_rows = dialogue.applied(one, by_rows)
            assert dialogue.before_run(of, n, dialogue.LAST) == by_rows
            assert dialogue.applied(dialogue.matrix_of([(of, n)]), dialogue.LAST) == by_rows
    assert max(len(p) for p in dialogue._powers.values()) == 6


def shard_facts(rows):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["__shard"]] += r["__size"]
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


@pytest.fixture(scope="module")
def weighty(spark):
    """A third of the rows are copies of one text; texts of up to 20,000 bytes."""
    draw = random.Random(3)
    rows = [(i, "x" * int(10 ** draw.uniform(0, 4.3)) + str(i), "en") for i in range(3000)]
    rows += [(10_000 + i, "é" * 50, "en") for i in range(1500)]
    rows += [(None, None, None), (None, None, None), (7, "", "de"), (7, "", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_equal(weighty, shards):
    found = sharding.shard(weighty.withColumn("__key", F.lit(1)), shards).collect()
    want = weighty.collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in found) == Counter(map(tuple, want))
    assert all(r["__size"] == 16 + len((r.text or "").encode()) for r in found)
    sizes = shard_facts(found)
    share, largest = sum(sizes.values()) / shards, max(r["__size"] for r in found)
    assert all(abs(sizes[s] - share) <= largest + 2 * sharding.TOLERANCE * share for s in range(shards))
    assert set(sizes) == set(range(shards))
    groups = defaultdict(set)
    for r in found:
        groups[r.text].add(r["__shard"])
    # only a group that is too large for one shard, or lies at a border, is in several neighbouring ones
    assert all(max(s) - min(s) == len(s) - 1 for s in groups.values())
    assert sum(len(s) > 1 for s in groups.values()) <= shards
    again = {(r.doc_id, r.text): (r["__shard"], r["__slot"]) for r in sharding.shard(weighty, shards).collect() if r.doc_id not in (None, 7)}
    assert again == {(r.doc_id, r.text): (r["__shard"], r["__slot"]) for r in found if r.doc_id not in (None, 7)}


def test_shard_query_columns(spark, docs, rows, odd, empty):
    found = sharding.placed(docs).collect()
    texts = dict(rows)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 40
    assert len(found) == len(rows) and sharding.placed(odd).count() == 11 and sharding.placed(empty).count() == 0


def test_splitters_are_exact(spark, weighty):
    """Bytes and rows said to lie below each splitter do."""
    keyed = weighty.select(sharding.row_key(weighty.columns).alias("key"), sharding.row_size().alias("size"))
    rows = [(r.key, r.size) for r in keyed.collect()]
    for slack in (0.0, 500.0):
        found = sharding.splitters(keyed, 9, slack)
        assert [s.key for s in found] == sorted(s.key for s in found)
        for s in found:
            assert (s.size, s.rows) == (sum(n for k, n in rows if k < s.key), sum(k < s.key for k, _ in rows))


def terms_of(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]


def divergence_by_hand(rows, least, top):
    docs = [((lang or ""), (source or ""), terms_of(text or "")) for _, text, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in held.items()}
    for lang, _, _ in docs:
        kept.setdefault(lang, set())

    def shares(count, terms):
        whole = sum(count[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 1_000_000_000 * (count[t] + 5) // whole for t in terms}

    out = []
    for lang, source in counts:
        terms, p = kept[lang], shares(counts[lang, source], kept[lang])
        pairs = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                q = shares(counts[lang, other], terms)
                pairs.append((other, sum(abs(p[t] - q[t]) for t in terms)))
        q = shares(sum((c for (at, _), c in counts.items() if at == lang), Counter()), terms)
        more = [(t, p[t] - q[t]) for t in terms if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", more, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return Counter(out)


def test_divergence(spark, empty, monkeypatch):
    draw = random.Random(9)
    vocabulary = [f"{'abcdefgh'[i % 8]}{'xyzw' * (i % 3)}{chr(0xE0 + i % 30)}" for i in range(120)] + ["Same", "SAME", "same", "漢字"]
    rows = []
    for i in range(260):
        words = [draw.choice(vocabulary[: draw.choice([20, 124])]) for _ in range(draw.randrange(0, 60))]
        rows.append((i, draw.choice([" ", ", ", "1", "\n"]).join(words), draw.choice(["en", "de", "fr"]), f"s{draw.choice([0, 0, 0, 1, 2, 3])}"))
    rows += [(None, None, None, None), (1, "only here", "xx", "a"), (2, "", "xx", "b"), (3, "", "yy", "a"), (4, "many " * 3000, "en", "rare")]
    rows += [rows[0]] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    table = table.selectExpr("*", "'x' as term", "1 as n", "2 as total", "3 as block")
    for least, top, size, flush in ((8, 50, 2048, 150_000), (3, 4, 16, 40), (10_000, 50, 2048, 150_000)):
        monkeypatch.setattr(divergence, "BLOCK_TERMS", size)
        monkeypatch.setattr(divergence, "FLUSH", flush)
        assert Counter(map(tuple, divergence.divergence(table, least, top).collect())) == divergence_by_hand(rows, least, top)
    assert divergence.divergence(empty).count() == 0


def test_trees_share_equal_parts():
    draw = random.Random(10)
    forest = divergence.Forest(1000)
    counts = [{i: draw.randrange(1, 4) for i in draw.sample(range(1000), 30)} for _ in range(6)]
    counts.append(dict(counts[0]))
    roots = [forest.tree(sorted(c.items())) for c in counts]
    assert roots[0] == roots[6] and len(forest.parts) < 7 * 30 * 11 + 20
    x, y = divergence.share(90, 1000), divergence.share(70, 1000)
    for a in range(7):
        for b in range(7):
            known = {}
            want = sum(abs(x(counts[a].get(i, 0)) - y(counts[b].get(i, 0))) for i in range(1000))
            assert forest.distance(roots[a], roots[b], x, y, known) == want
            assert len(known) < 30 * 2 * 11 + 20
