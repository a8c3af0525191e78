"""Operators 3, 5, 8 and 9 on odd input, against plain versions; no Python in their plans."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from moldwatch.llm import chat, decontam, licences, quality
from moldwatch.llm.queries import QUERIES
from moldwatch.llm.store import written
from tests.conftest import SF_SMALL
from tests.llm import helpers
from tests.llm.conftest import PROSE


def rows_by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op3_decontaminate", "op5_licences", "op8_quality", "op9_chat"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


ITEMS = [(1, " ".join(PROSE.split()[5:20])), (2, "a b c"), (3, None), (4, "!!"), (5, "Abc"), (6, " ".join(PROSE.split()[5:20])),
         (None, " ".join(PROSE.split()[30:45])), (7, "words that no document has in this order at all never ever"), (1, "one")]


def test_contamination_against_brute_force(spark, odd_docs, odd_rows):
    items = spark.createDataFrame([i + ("x", 3) for i in ITEMS], "item_id bigint, text string, win string, off int")
    short = [(i, t) for i, t, _ in odd_rows if len(t or "") < 40_000]
    docs = odd_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 40_000)
    want = []
    for i, t in short:
        n, hit, found = helpers.contamination(t, ITEMS)
        want.append((i, n, len(hit), sorted(str(f) for f in found if f is not None)))
    for blocks in (500_000, 7):  # one block; several
        got = decontam.contamination(docs, items, block_windows=blocks)
        assert rows_by(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=str)


def test_contamination_of_long_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(odd_docs.filter("doc_id IN (6, 11)"), items).collect()}
    assert got[6]["n_hit"] == 1500 * 30 and got[11]["n_hit"] == 0  # two passages a line: 15 words each
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.contamination(odd_docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_licences(spark, odd_docs, no_docs):
    text = ("Released under the MIT License. " + PROSE + " Licensed under CC BY-NC 4.0. gnu General public LICENSE "
            "this mentions apache and license but not together; cc  by, mit license mit license")
    docs = spark.createDataFrame([(1, text), (2, "gpl"), (3, "Licensed under the GNU General Public License, version 3"),
                                  (4, "licensed beneath the gnu general public license version 3")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    w = helpers.words(text)
    base = sorted((i, t.label) for t in licences.BASE for i in range(len(w)) if w[i:i + len(t.words.split())] == t.words.split())
    assert sorted((m["start"], m["label"]) for m in got[1]["matches"] if m["base"]) == base and len(base) == 6
    assert {"mit", "cc-by-nc-4.0", "gpl"} <= {m["label"] for m in got[1]["matches"]}
    assert got[2]["matches"] == [] and "gpl-3.0" in {m["label"] for m in got[3]["matches"]}
    fuzzy = [m for m in got[4]["matches"] if m["label"] == "gpl-3.0"]
    assert fuzzy and fuzzy[0]["score"] < 1  # one word of the notice differs
    assert licences.scan_licences(no_docs).count() == 0
    assert licences.scan_licences(odd_docs).count() == odd_docs.count()
    assert licences.scan_licences(odd_docs).agg(F.sum(F.size("matches"))).first()[0] == 0


def test_quality_measures(spark, odd_docs, odd_rows, no_docs):
    random.seed(5)
    more = [(100 + i, " ".join(random.choices("a bb c\n| d# e", k=random.randint(0, 90)))) for i in range(60)]
    docs = odd_docs.select("doc_id", "text", "ledger", "row").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string").select("*", F.lit("").alias("ledger"), F.lit("").alias("row")))
    got = quality.ledger(docs).select("row.doc_id", "ledger.*")
    want = [(i, *helpers.quality(t)) for i, t in [(r[0], r[1]) for r in odd_rows] + more]
    assert rows_by(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)
    assert quality.ledger(no_docs).count() == 0


def test_quality_windows_beyond_the_packed_places(spark, monkeypatch):
    text = " ".join(random.Random(3).choices("abcdefgh", k=400))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    want = helpers.quality(text)[4]
    assert quality.ledger(docs).select("ledger.n_repeat_words").first()[0] == want
    monkeypatch.setattr(quality, "PLACE_BITS", 8)  # the text has more words than places: the exact sort decides
    assert quality.ledger(docs).select("ledger.n_repeat_words").first()[0] == want


def test_policies_and_ablations(spark):
    bits = [0, 1, 2, 4, 5, 4, 64, 68, 0]
    entries = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    mask = quality.POLICIES["v2"]
    got = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["kept_without"]) for r in quality.ablations(entries, mask).collect()}
    for r in quality.RULES:
        bit = 1 << r.bit
        assert got[r.name] == (sum(bool(b & bit) for b in bits), bits.count(bit), sum(not b & mask & ~bit for b in bits))
    assert entries.filter(quality.passes(F.col("fail_bits"), quality.POLICIES["v1"])).count() == 3


def tree(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, id bigint, parent bigint, role string, text string, score double")


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
            (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "x", 0.4), (1, 6, 4, "assistant", "y", 0.8),
            (2, 1, 99, "user", "root by a missing parent", None), (None, 1, None, "user", "null tree", 0.0),
            (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "assistant", "below it", 0.0),
            (4, 1, None, None, None, 0.0), (4, 1, None, None, None, 0.0)]
    m = tree(spark, rows)
    every = chat.format_conversations(m, top=None).select("conv_id", "leaf", "rank", "formatted",
                                                          chat.read_back(F.col("formatted")).alias("turns")).collect()
    paths = {(r["conv_id"], r["leaf"]): ([t["text"] for t in r["turns"]], r["rank"]) for r in every}
    assert paths == {(1, "=2"): (["q", "bad"], 3), (1, "=6"): (["q", "good", "more", "y"], 1), (1, "=5"): (["q", "good", "more", "x"], 2),
                     (2, "=1"): (["root by a missing parent"], 1), (None, "=1"): (["null tree"], 1), (4, "=1"): ([""], 1)}
    best = chat.format_conversations(m).collect()
    assert {(r["conv_id"], r["leaf"]) for r in best} == {(1, "=6"), (2, "=1"), (None, "=1"), (4, "=1")}
    assert chat.format_conversations(tree(spark, [])).count() == 0


def test_a_deep_thread(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(1000)]
    r = chat.format_conversations(tree(spark, rows)).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in r["t"]] == [f"t{i}" for i in range(1000)]


def test_only_chosen_branches_of_a_comb_are_written(spark, monkeypatch):
    """A thread of 300 messages with a leaf below each: 45,450 messages on all paths, 301 on the best one."""
    rows = [(1, i, i - 1 if i else None, "user", f"m{i}", 0.5) for i in range(300)]
    rows += [(1, 1000 + i, i, "assistant", f"a{i}", 5.0 if i == 299 else i / 1000) for i in range(300)]
    counts = {}

    def counted(df, name):
        out = written(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(chat, "written", counted)
    best = chat.format_conversations(tree(spark, rows)).select("leaf", "score", "n_turns").first()
    assert (best["leaf"], best["n_turns"]) == ("=1299", 301)
    assert abs(best["score"] - (300 * 0.5 + 5.0) / 301) < 1e-12
    assert counts["paths"] < 2000


def test_path_scores_against_a_walk(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.randrange(i) if i and rng.random() < .9 else None, "user", "x", rng.choice([None, rng.random()]))
            for t in range(3) for i in range(60)]
    found = chat.format_conversations(tree(spark, rows), top=None).select("conv_id", "leaf", "rank", "score", "n_turns").collect()
    expected = {}
    for t in range(3):
        own = {i: (parent, score or 0.0) for k, i, parent, _, _, score in rows if k == t}
        for leaf in set(own) - {parent for parent, _ in own.values()}:
            scores, at = [], leaf
            while at is not None:
                scores.append(own[at][1])
                at = own[at][0]
            expected[t, f"={leaf}"] = (sum(scores) / len(scores), len(scores))
    assert {(r["conv_id"], r["leaf"]): (round(r["score"], 9), r["n_turns"]) for r in found} == {
        k: (round(s, 9), n) for k, (s, n) in expected.items()}
    for t in range(3):
        scores = [r["score"] for r in sorted((r for r in found if r["conv_id"] == t), key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True)


def test_chat_round_trip(spark):
    random.seed(2)
    bits = ["<|im_start|>", "<|im_end|>", "\\", "\\\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", " ", "é", "😀",
            "<", "|", "a", "$1", "<\\s>", "\x00", "%"]
    rows = []
    for c in range(40):
        for t in range(random.randint(1, 6)):
            text = None if random.random() < .1 else "".join(random.choices(bits, k=random.randint(0, 12)))
            rows.append((c if c else None, t, random.choice(["user", "assistant", "system", "tool\n<|im_end|>", None]), text, "x"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id string")
    out = chat.format_conversations(chat.conversation_messages(df))
    out = out.select("conv_id", "formatted", "spans", chat.read_back(F.col("formatted")).alias("turns"),
                     chat.masked_text(F.col("formatted"), F.col("spans")).alias("loss"))
    seen = {r["conv_id"]: r for r in out.collect()}
    assert len(seen) == 40
    for c, r in seen.items():
        own = [(role or "", text or "") for k, t, role, text, _ in rows if k == c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        for s in r["spans"]:
            part = r["formatted"][s["start"]:s["start"] + s["chars"]]
            assert part.encode() == r["formatted"].encode()[s["byte_start"]:s["byte_start"] + s["bytes"]]
        bodies = re.split(r"<\|im_start\|>[^\n]*\n|<\|im_end\|>\n", r["formatted"])
        assert not any(re.search(r"<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>", b) for b in bodies)


def test_probe_conversation(spark):
    r = QUERIES["op9_chat"](spark, SF_SMALL).filter("conv_id = -1").first()
    probe = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(probe)
    assert r["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()


def test_contamination_blocks_hold_each_window_once(spark, monkeypatch):
    """Items that share a window don't make a block larger, and are all listed."""
    shared = " ".join(f"w{i}" for i in range(10))
    items = [(i, f"{shared} own{i}") for i in range(600)] + [(None, shared), (7, None)]
    docs = [(1, f"x {shared} y"), (2, "nothing here"), (None, f"{shared} own3"), (None, f"{shared} own3"), (4, None)]
    seen = []
    monkeypatch.setattr(decontam, "_postings", lambda part, *a, f=decontam._postings: seen.append(part.count()) or f(part, *a))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"),
                                 block_windows=100).collect()
    assert len(seen) == 7 and sum(seen) == 601 and max(seen) < 150
    by = sorted(((r["doc_id"], r["n_hit"], len(r["items"])) for r in got), key=repr)
    assert by == sorted([(1, 10, 600), (2, 0, 0), (None, 11, 600), (None, 11, 600), (4, 0, 0)], key=repr)
