"""Token alignment: against whole-text tokenisation by brute force, with all and with few segments and pairs shipped."""

from __future__ import annotations

import hashlib

import pytest

from tallyforge.llm import crosstokens as ct

ODD = [
    (1, "Plain words, twice: plain words."), (2, None), (3, ""), (4, " "), (5, "  two  spaces  "), (6, "a ▁ b"), (7, "tab\t x\n y\r\n\n  z"), (8, "nbsp  x    y　 z   w"),
    (9, "<|endoftext|> </s> <s>[INST] <unk> <0x41>"), (10, "nul \x00 \x1c \x1c  \x85 x"), (11, "日本語 テスト😀 👩‍👩‍👧 é é"), (12, "x" * 5000), (13, "don't 's 123 4567 !!! ...  ?"), (None, "Plain words, twice: plain words."),
    (None, None), (1, "Plain words, twice: plain words."), (1, "Plain words, twice: plain words."), (14, "y" * 60 + " " + "y" * 60 + " end "), (15, "\n"), (16, "end\n "), (17, "ﬁ ½ Å ①  ﷺ"),
]


def brute(rows, digest=True):
    with open(ct.A_FILE, encoding="utf-8") as a, open(ct.B_FILE, "rb") as b:
        pair = ct.TokenizerPair(a.read(), b.read())
    made, counts = [], {}
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        spans = []
        for ids, known in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(known[t])))
                at = own[-1][1]
            spans.append(own)
        if not text or any(b"".join(known[t] for t in ids) != whole for ids, known in ((a, pair.a_bytes), (b, pair.b_bytes))):
            made.append((i, 0, 0, 0, [], ""))
            continue
        links, start = [], 0
        for x, (lo, hi) in enumerate(spans[0]):
            while spans[1][start][1] <= lo:
                start += 1
            y = start
            while y < len(b) and spans[1][y][0] < hi:
                links.append((a[x], b[y]))
                y += 1
        both = sorted({hi for _, hi in spans[0]} & {hi for _, hi in spans[1]})
        groups, lo = [], 0
        for hi in both:
            groups.append("|".join(",".join(str(t) for t, (s, e) in zip(ids, own) if lo <= s and e <= hi) for ids, own in zip((a, b), spans)) if len(whole) < 400 else (lo, hi))
            lo = hi
        if len(whole) >= 400:
            ends = [{e: k for k, (_, e) in enumerate(own)} for own in spans]
            at, out = [0, 0], []
            for _, hi in groups:
                to = [ends[0][hi] + 1, ends[1][hi] + 1]
                out.append("|".join(",".join(map(str, ids[f:t])) for ids, f, t in zip((a, b), at, to)))
                at = to
            groups = out
        made.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    digested = lambda g: hashlib.sha256(g.encode()).hexdigest() if g and digest else g
    return sorted(repr((i, na, nb, ng, len(ls), digested(g), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls))) for i, na, nb, ng, ls, g in made)


def got(df, groups="groups"):
    return sorted(repr(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", groups, "n_best", "count_sum"))) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id bigint, text string, seg string, n int")


def test_query_equals_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(ct.op12_token_alignment(spark, data), "groups_sha256") == brute(rows)


@pytest.mark.parametrize("head,pairs", [(1 << 18, 1 << 20), (5, 7), (0, 0)])
def test_odd_rows(odd, monkeypatch, head, pairs):
    monkeypatch.setattr(ct, "HEAD", head)
    monkeypatch.setattr(ct, "HEAD_PAIRS", pairs)
    assert got(ct.align_documents(odd)) == brute(ODD, digest=False)


def test_empty_table_and_uncut_texts(odd, monkeypatch):
    assert ct.align_documents(odd.where("false")).count() == 0
    monkeypatch.setattr(ct.TokenizerPair, "cuts", lambda self: False)
    few = odd.where("doc_id IN (1, 5, 7, 13)")
    assert got(ct.align_documents(few)) == brute([r for r in ODD if r[0] in (1, 5, 7, 13)], digest=False)


def test_cuts_are_verified():
    with open(ct.A_FILE, encoding="utf-8") as a, open(ct.B_FILE, "rb") as b:
        a_json, b_model = a.read(), b.read()
    pair = ct.TokenizerPair(a_json, b_model)
    assert pair.cuts()
    pair.a_bytes[1] = b"of the"
    assert not pair.cuts()
    assert ct.segments("a b  c\n d  e ", True) == ["a", "b", " c\n d  e", ""]


def test_links_of_many_segments_at_once():
    """Links made over all segments together are those of each segment alone, tokens of no bytes included."""
    import random

    pick = random.Random(5)
    for least in (1, 0):
        lengths = ct.Lengths({i: 1 + i % 7 for i in range(40)}, {i: max(i % 5, least) for i in range(30)})
        groups: list[str | None] = [None]
        while len(groups) < 300:
            a, b = [pick.randrange(40) for _ in range(pick.randrange(1, 12))], []
            left = sum(lengths.a_len[i] for i in a)
            while left:
                b.append(pick.choice([i for i in range(30) if lengths.b_len[i] <= left and (b or lengths.b_len[i])]))
                left -= lengths.b_len[b[-1]]
            groups.append(pick.choice([None, *[ct.TokenizerPair.groups(lengths, a, b)] * 9]))
        alone = [lengths.entry(g) if g is not None else (0, 0, 0, []) for g in groups]
        given = [g for g in groups if g is not None]
        numbers, sizes, links = ct._entries(lengths, given)
        assert len(numbers) == len(sizes) == len(given)
        found = ct.Entries(lengths, groups)
        assert found.numbers.tolist() == [list(x[:3]) for x in alone]
        assert found.sizes.tolist() == [len(x[3]) for x in alone]
        assert found.links.tolist() == [link for x in alone for link in x[3]]
    assert ct.Entries(lengths, []).links.tolist() == ct.Entries(lengths, [None]).links.tolist() == []


def test_cuts_follow_characters_that_are_not_white_space():
    assert ct.segments(" a  b\n c d ", True) == [" a", " b\n c", "d", ""]
    assert ct.segments("x　 y é ", True) == ["x　 y", "é", ""]
