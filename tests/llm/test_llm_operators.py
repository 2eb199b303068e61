"""The text operators: against DuckDB or brute force, on odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from conftest import duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import chatformat, components, decontam, langid, linededup, lyndon, mixing, quality_model, quality_rules, queries, simhash, skew, suffixdedup, tokencount

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
ROWS = [
    (1, "the cat sat on the mat and then it went to the house of the dog by the sea " * 4, "en", "a"),
    (2, "der hund und die katze sind in dem haus und sie schlafen auf dem bett " * 4, "de", "a"),
    (3, None, "en", None), (4, "", None, "a"), (None, "le chat est dans la maison avec le chien et les enfants", "fr", "b"), (None, None, None, None),
    (5, "el perro y el gato están en la casa con los niños", "es", "b"), (6, LONG, "en", "a"), (7, "12 34 !!", "en", "a"), (8, "same row\nsame row\n\nsame  row", "en", "a"), (8, "same row\nsame row\n\nsame  row", "en", "a"),
    (9, "café ÉTÉ A B C \U0001f600 zürich", "fr", "a"),
]
#: Names that the operators use inside.
CLASHES = ("key", "hits", "words", "n", "h", "fp", "tok", "gram", "score", "starts", "spans", "line", "at")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.REGISTRY.oracles))
def test_query_equals_duckdb(spark, data, name):
    names, rows = duck_rows(queries.REGISTRY.oracles[name], data)
    df = queries.REGISTRY.queries[name](spark, data)
    assert sorted(df.columns) == names and spark_rows(df) == rows


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ROWS) and all(r["n"] == "x" for r in got)
    assert {r["n_words"] for r in got if not r["text"]} == {0} and not any(r["kept"] for r in got if not r["text"])
    assert next(r for r in got if r["doc_id"] == 6)["n_repeat_words"] == 20_000
    assert {r["n_dup_lines"] for r in got if r["doc_id"] == 8} == {1}
    assert quality_rules.quality_rules(none).count() == 0


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Sat on the MAT and then it went to the house of the dog"), (2, "gato"), (3, None), (None, "hund und"), (2, "en la casa")], "item_id bigint, text string")
    got = decontam.decontaminate(odd, items).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["items"] == ["1"] and by[1]["n_hit"] == 14 * 4 and by[5]["items"] == ["2"] and by[5]["n_hit"] == 4
    assert by[2]["n_items"] == 0 and by[2]["contaminated"] and by[4]["n_words"] == 0
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3
    assert decontam.decontaminate(none, items).count() == 0
    assert decontam.decontaminate(odd, items.where("false")).where("contaminated").count() == 0


def test_language_model_and_odd_rows(spark, odd, none, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.LanguageModel(langid.training_sample(docs))
    held = langid.identify(docs.where(langid.held_out(F.col("doc_id"))).where("n_chars > 40"), model).where("lang IS NOT NULL")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    got = langid.identify(odd, model, prefix="_").collect()
    assert len(got) == len(ROWS) and {r["_lang_pred"] for r in got if r["doc_id"] in (3, 4, 7)} == {"und"} and all(0 <= r["_score"] <= 1 for r in got)
    assert langid.identify(none, langid.LanguageModel(langid.training_sample(none)), prefix="_").count() == 0
    assert langid.LanguageModel([]).predict("any text") == ("und", 0.0)
    assert model.predict("\u00bd \u00b2 \u2460 12") == ("und", 0.0) and model.predict("\u00bd a")[0] != "und"


def test_quality_model_and_odd_rows(spark, odd, none, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality_model.QualityModel(quality_model.training_sample(docs, labels))
    got = quality_model.score_quality(docs, model).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.8
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_quality(odd, model).collect())
    assert quality_model.score_quality(none, quality_model.QualityModel([])).count() == 0
    assert quality_model.QualityModel([("a", 1)]).score("x") == 0.5


def shingled(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(grams))


def brute_components(fps, limit=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    fps = [shingled(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{fp:016x}", docs[c]["doc_id"]) for r, fp, c in zip(docs, fps, brute_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(spark, data).collect()}
    assert got == want
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ROWS) and {r["fp"] for r in found if r["doc_id"] in (3, 4)} == {0}
    assert {r["component_id"] for r in found if r["fp"] == 0} == {3}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1 and kept.where("text IS NULL OR text = ''").count() == 1
    assert simhash.near_duplicates(none).count() == 0


def test_hot_buckets_are_dealt_again(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.near_edges(df, bucket=3)).collect()}
    groups = brute_components(fps)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    ours = [roots.get(sign(f), sign(f)) for f in fps]
    assert len(set(zip(groups, ours))) == len(set(groups)) == len(set(ours))


def test_line_dedup_odd_rows(spark, odd, none):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "_ld_lines", "_ld_gone"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and sorted(r["text"] for r in rows if r["doc_id"] == 8) == ["", "same row\n"]
    assert {r["_ld_lines"] for r in rows if r["text"] is None} == {1}
    assert linededup.dedup_lines(none).count() == 0


def test_repeated_rows_keep_their_lines_once(spark, monkeypatch):
    rows = [(8, "one line of text here\n\nand a second line"), (9, "and a second line\nown"), (8, "one line of text here\n\nand a second line"), (None, "null id line"), (None, "null id line"), (7, None), (7, None)]
    rows += [(20, "a hot row of words")] * 60
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            if not line.strip() or line not in seen:
                kept.append(line)
            seen.add(line)
        want.append((i, t if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lambda: sorted(map(repr, ((r["doc_id"], r["text"], r["_ld_gone"]) for r in linededup.dedup_lines(docs).collect())))
    assert got() == sorted(map(repr, want))
    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    assert got() == sorted(map(repr, want))


def test_texts_under_one_id_are_different_documents(spark):
    texts = [(1, "one shared line here"), (5, "one shared line here\nown words of a"), (5, "other clean line stays\nsecond text of b"), (7, "both have this line\ntail of c"), (7, "both have this line\nend of d")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(t for i, t in got if i != 7) == ["one shared line here", "other clean line stays\nsecond text of b", "own words of a"]
    assert sum("both have" in t for i, t in got if i == 7) == 1 and sum("tail of c" in t or "end of d" in t for i, t in got) == 2
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = words(80), words(80), words(80)
    rows = [(3, a), (3, b), (3, b), (3, a), (4, a), (9, c), (2, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(3, a), (3, b), (2, c)])


def edf(sizes, weights):
    """The whole schedule by one run through all slots, and each source's ideal share after every slot; exact fractions."""
    names = sorted(sizes)
    ends = sorted((Fraction(sizes[s], weights[s]), s) for s in names)

    def total(v):
        return sum(min(weights[s] * v, sizes[s]) for s in names)

    jobs = [(math.floor(total(Fraction(j, weights[s]))), math.ceil(total(Fraction(j + 1, weights[s]))), s, j) for s in names for j in range(sizes[s])]
    jobs.sort()
    ready, order, k = [], [], 0
    for t in range(len(jobs)):
        while k < len(jobs) and jobs[k][0] <= t:
            heapq.heappush(ready, jobs[k][1:])
            k += 1
        deadline, s, j = heapq.heappop(ready)
        assert t < deadline
        order.append((s, j))
    ideal, live, given, at = [], dict(weights), 0, Fraction(0)
    breaks = iter(ends)
    end, who = next(breaks)
    for t in range(1, len(order) + 1):
        while total(end) < t:
            end, who = next(breaks)
        flow = sum(w for s, w in weights.items() if Fraction(sizes[s], w) >= end)
        v = end - (total(end) - t) / Fraction(flow)
        ideal.append({s: min(weights[s] * v, Fraction(sizes[s])) for s in names})
    return order, ideal


@pytest.mark.parametrize("sizes", [[950] + [100] * 19, [1200 // (k + 1) for k in range(40)], [4000, 1, 9, 30]], ids=["hot", "zipf", "tiny"])
def test_mix_is_within_a_block_everywhere(spark, sizes):
    counts = spark.createDataFrame([(f"s{k:03}", n) for k, n in enumerate(sizes)], "src string, n bigint")
    aims = {r["src"]: r["a"] for r in mixing.shares(counts).collect()}
    assert all(a / aims["s000"] == pytest.approx((n / sizes[0]) ** 0.5) for a, n in zip((aims[f"s{k:03}"] for k in range(len(sizes))), sizes))
    rows = sorted(mixing.schedule(mixing.shares(counts), block_docs=4, stretch=64).collect(), key=lambda r: r["slot"])
    blocks = {f"s{k:03}": -(-n // 4) for k, n in enumerate(sizes)}
    order, ideal = edf(blocks, aims)
    assert [r["slot"] for r in rows] == list(range(sum(blocks.values()))) and [(r["src"], r["block"]) for r in rows] == order
    seen = Counter()
    for r, aim in zip(rows, ideal):
        seen[r["src"]] += 1
        assert all(abs(seen[s] - x) < 1 for s, x in aim.items())


def test_mix_odd_rows_and_given_weights(spark, odd, none):
    docs = spark.createDataFrame([(k, "abcd"[min(3, k % 7)]) for k in range(400)], "doc_id bigint, source string")
    rows = mixing.mix_sources(docs, weights={"a": 1, "b": 2, "c": 3, "d": 4}, block_docs=2).collect()
    owner = {r["mix_slot"]: r["source"] for r in rows}
    assert len(rows) == 400 and sorted(owner) == list(range(len(owner))) and len({(r["mix_slot"], r["mix_pos"]) for r in rows}) == 400
    assert Counter(owner[t] for t in range(90)) == {"a": 9, "b": 18, "c": 27, "d": 36}  # as long as none ends
    mixed = mixing.mix_sources(odd)
    assert mixed.count() == len(ROWS) and mixed.columns[: len(odd.columns)] == odd.columns
    assert mixing.mix_sources(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, weights={"a": 0})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_sorted(symbols):
    assert lyndon.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("length,gram", [(8, 5), (12, 12), (10, 4)])
def test_suffix_dedup_equals_brute_force(spark, length, gram):
    rng = random.Random(length)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts = [*base, *[b[:20] + "X" + b[21:] for b in base[:20]], "", None, "a" * 50, "é" * 30, base[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffixdedup.dedup_bytes(df, length, gram).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got] == suffixdedup.brute_force(texts, length)


@pytest.mark.parametrize("seed", range(20))
def test_records_of_a_gram_are_settled_by_their_suffixes(seed):
    rng = random.Random(seed)
    side = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode()
    records = [(*sides, rng.choice([1, 1, 1, 2])) for sides in {(side(), side()) for _ in range(rng.randint(1, 40))}]
    need, seen, tally = 10, Counter(), Counter()
    windows = lambda left, right: {(a, (left[a:], right[: need - 1 - len(left[a:])])) for a in range(len(left) + 1) if 0 <= need - 1 - len(left[a:]) <= len(right)}
    for left, right, n in records:
        for _, window in windows(left, right):
            seen[window] += n
    got = suffixdedup.repeated_windows(records, 14, 5, tally)
    for (left, right, _), runs in zip(records, got):
        assert {a for x, y in runs for a in range(x, y + 1)} == {a for a, window in windows(left, right) if seen[window] > 1}
    if len(records) > 1:  # what is not cut away goes through the suffix array, every removed window among it
        assert tally["alone"] == 0 and tally["sorted"] + tally["cut"] == len(records)
        assert sum(map(bool, got)) <= tally["sorted"]


def test_suffix_dedup_whole_table_and_odd_rows(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in docs), suffixdedup.brute_force([r["text"] for r in docs])))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.op5_suffix_dedup(spark, data).collect()} == want
    assert suffixdedup.dedup_bytes(odd).count() == len(ROWS) and suffixdedup.dedup_bytes(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/\\sINSTYOLER ok", max_size=40))
def test_escape_round_trip(text):
    form = chatformat.BracketTemplate()
    out = form([("user", text), ("assistant", text), ("system", text), (text, text)])
    assert form.read_back(out) == [("user", text), ("assistant", text), ("system", text), (text, text)]
    spans = chatformat.render(form, [("user", text), ("assistant", text)]).spans
    assert form.unescape(form([("user", text), ("assistant", text)])[slice(*spans[1])]) == text


def test_rewritten_history_is_reported(spark, data):
    def forgetful(turns):
        return "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}</{r}>" for k, (r, t) in enumerate(turns))

    got = chatformat.render(forgetful, [("user", "hello there"), ("assistant", "hi"), ("user", "bye"), ("assistant", "ok")])
    assert got.rewrites == [2, 3] and got.spans[0] is None and got.output[slice(*got.spans[3])] == "ok"
    turns = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (None, 1, "assistant", "x"), (2, None, "tool", "</s>")], "conv_id bigint, turn bigint, role string, text string")
    rows = {r["conv_id"]: r for r in chatformat.format_conversations(turns).collect()}
    assert rows[1]["n_turns"] == 2 and rows[None]["loss_chars"] == 1 and rows[2]["loss_chars"] == 0
    assert chatformat.format_conversations(turns.where("false")).count() == 0


def test_token_counts_equal_brute_force(odd, none):
    trie = tokencount.UnigramTrie(["a", "b", "ab", "aba", "ba", tokencount.MARK, tokencount.MARK + "a"])
    words = [tokencount.MARK + w for w in ("abab", "aba", "b", "abcé", "", "abaab")]

    def best(w):
        if not w:
            return (0.0, 0)
        width = len(w[-1].encode())
        ways = [(lambda s, c: (s + width * trie.byte_score, c - width))(*best(w[:-1]))]
        ways += [(best(w[:i])[0] + trie.scores[w[i:]], best(w[:i])[1] - 1) for i in range(len(w)) if w[i:] in trie.scores]
        return max(ways)

    assert trie.counts(words) == {w: -best(w)[1] for w in words}
    got = tokencount.count_tokens(odd.select("doc_id", "text", "key")).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0} and all(r["n_tokens"] >= r["n_pretokens"] for r in got)
    assert tokencount.count_tokens(none.select("doc_id", "text")).count() == 0


def test_results_win_over_columns_of_their_names(spark):
    """A column named as a result gives way to it, and no name comes twice."""
    docs = spark.createDataFrame([(1, "three plain words", 70, "x")], "doc_id bigint, text string, n_words bigint, N_Tokens string")
    rules = quality_rules.quality_rules(docs)
    assert [c.lower() for c in rules.columns].count("n_words") == 1 and rules.first()["n_words"] == 3 and rules.first()["N_Tokens"] == "x"
    tokens = tokencount.count_tokens(docs)
    assert [c.lower() for c in tokens.columns].count("n_tokens") == 1 and tokens.first()["n_tokens"] >= 3 and tokens.first()["n_words"] == 70
    named = docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit("x")})
    found = langid.identify(named, langid.LanguageModel([("some words", "en"), ("ein wort", "de")]))
    assert found.columns.count("lang_pred") == found.columns.count("score") == 1 and 0 <= found.first()["score"] <= 1


def test_lost_spans_are_counted(spark):
    class Forgetful(chatformat.BracketTemplate):
        """Blanks all texts but the last one's, so that earlier spans are lost."""

        def __call__(self, turns):
            return super().__call__([(role, "" if k < len(turns) - 1 else text) for k, (role, text) in enumerate(turns)])

    turns = spark.createDataFrame([(1, 0, "assistant", "hello"), (1, 1, "user", "b"), (1, 2, "assistant", "end"), (2, 0, "assistant", "one")], "conv_id bigint, turn bigint, role string, text string")
    lost = lambda form: {r["conv_id"]: r["n_lost"] for r in chatformat.format_conversations(turns, form).collect()}
    assert lost(None) == {1: 0, 2: 0}
    assert lost(Forgetful()) == {1: 1, 2: 0}


def test_pipeline(spark, data, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data).collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "mix_slot"} <= set(out[0].asDict())
    assert len({r["doc_id"] for r in out}) == len(out) < docs.count()
    assert sorted({r["mix_slot"] for r in out}) == list(range(len({r["mix_slot"] for r in out})))
    kept = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, data)
        assert after.columns == kept.columns, name
        kept = after.checkpoint()
    assert corpus_pipeline.STAGES[-1][1](spark, kept.where("false"), data).count() == 0


def brute_line_dedup(docs):
    """The texts without lines that are 4/5 similar to an earlier line, by comparing each with all that share a word."""
    seen, by_word, out = [], {}, []
    for text in (d["text"] for d in docs):
        kept, lines = [], text.split("\n")
        for line in lines:
            words = set(re.split(r"[ \t\r\x0b\f]+", line.lower())) - {""}
            common = Counter(k for w in words for k in by_word.get(w, ()))
            if not any(5 * n >= 4 * (len(words) + seen[k] - n) for k, n in common.items()):
                kept.append(line)
            for w in words:
                by_word.setdefault(w, []).append(len(seen))
            seen.append(len(words))
        out.append("\n".join(kept))
    return out


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", lowered)


def brute_pipeline(docs, items):
    """The rows (dicts, by id) after each stage but mixing, without Spark."""
    rows = [dict(d) for d in docs if any(c.isalpha() for c in d["text"] or "")]
    yield rows
    rows = [{**d, "text": t, "n_chars": len(t)} for d, t in zip(rows, brute_line_dedup(rows))]
    yield rows
    rows = [d for k, (d, c) in enumerate(zip(rows, brute_components([shingled(d["text"]) for d in rows]))) if k == c]
    yield rows
    windows = {tuple(w[i : i + 10]) for t in items for w in [brute_words(t or "")] if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    yield [d for d in rows if clean(brute_words(d["text"]))]


def test_pipeline_equals_brute_force(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    by_id = lambda df: [r.asDict() for r in df.orderBy("doc_id").collect()]
    kept, counts = docs, [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_pipeline(by_id(docs), items)):
        kept = stage(spark, kept, data).checkpoint()
        got = by_id(kept)
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want], name
        assert got == want, name
        counts.append(len(got))
    mixed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, kept, data).collect()]
    assert sorted(({k: r[k] for k in docs.columns} for r in mixed), key=lambda r: r["doc_id"]) == want
    for source in {r["source"] for r in mixed}:
        own = sorted((r for r in mixed if r["source"] == source), key=lambda r: (r["mix_slot"], r["mix_pos"]))
        assert [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    print("documents after each stage:", counts)
