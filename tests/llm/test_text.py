"""Byte BPE, wavelet shards, lattices, HTML rules and packing plans, without Spark."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardlens.llm import bpe, decontaminate, htmltext, jaccard, lattice, packing, warc, wavelet
from boardlens.llm import words as W
from boardlens.llm.paths import tokenizer_file

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abz  AZ.\n\t 　\x1cé😀'st"), max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_units_give_the_ids_of_whole_texts(texts):
    coder = bpe.load(tokenizer_file("byte_bpe_50k.json"))
    got = [(c, i) for _, _, c, i in coder.encode(pa.array(texts, pa.string()))]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [n for c, _ in got for n in c.tolist()] == [len(w) for w in want]
    assert [x for _, i in got for x in i.tolist()] == [x for w in want for x in w]


def test_key_table_grows_and_finds():
    t = bpe.KeyTable(4)
    keys = W.mix(np.arange(1, 5000, dtype=np.uint64))
    t.insert(keys, np.arange(len(keys), dtype=np.int32))
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(W.mix(np.arange(9000, 9100, dtype=np.uint64))) == -1).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=300))
def test_wavelet_answers(ids):
    a = np.array(ids, np.uint32)
    s = wavelet.Shard(wavelet.write_shard(a, np.array([5]), np.array([True]), np.array([len(a)])))
    assert s.decode().tolist() == ids and len(s) == len(ids)
    for i in range(0, len(ids), 7):
        assert s.access(i) == ids[i]
        at = [j for j, x in enumerate(ids) if x == ids[i]]
        assert s.count(ids[i]) == len(at) and s.select(ids[i], len(at) - 1) == at[-1] and s.count(ids[i], 0, i) == sum(j < i for j in at)
    assert s.count(99999) == 0


def test_word_spans_equal_a_regular_expression():
    texts = ["A b\tc", None, "", "  x ", "é y z\x0b", "end"]
    (_, _, data, offsets), *rest = W.text_chunks(pa.array(texts))
    assert not rest
    s, e, row = W.word_spans(W.LOWER[data], offsets)
    got = [(int(r), W.LOWER[data][a:b].tobytes().decode()) for a, b, r in zip(s, e, row, strict=True)]
    tr = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(tr))]


def test_masks_hit_every_window():
    def hit(n, gone):
        return any(all(i + p < n and i + p not in gone for p in m) for m in decontaminate.MASKS for i in range(n - m[-1]))

    assert all(hit(13, set(g)) for g in itertools.combinations(range(13), 2))
    assert all(hit(16, set(g)) for g in itertools.combinations(range(16), 3))


def test_lattice_sums_over_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    p = np.array([0.1, 0.2, 0.2, 0.2, 0.2, 0.1])
    lat = lattice.Lattice(pieces, np.log(p))

    def total(s):
        return 1.0 if not s else sum(p[i] * total(s[len(x) :]) for i, x in enumerate(pieces) if s.startswith(x))

    for w in (b"a", b"ab", b"abab", b"bba" * 30):
        assert lat.score([w])[0] == pytest.approx(np.log(total(b" " + w)) if len(w) < 20 else lat._scalar(b" " + w)[0][-1])
    uses = lat.expect([b"ab"], np.array([2.0]))
    # Segmentations of " ab" weighted by probability, twice.
    segs = {(0, 1, 2): 0.004, (0, 3): 0.02, (4, 2): 0.04}
    want = np.zeros(6)
    for s, q in segs.items():
        for i in s:
            want[i] += 2 * q / sum(segs.values())
    assert uses == pytest.approx(want)


def test_main_text_of_pages():
    page = """<html><head><title>t</title><script>if (a<b) { "</p>" }</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>
    <div class="cookie-notice">We use cookies and it is for the good of all that is on this page and in it</div>
    <article><h1>Head &amp; line</h1><p>The text of the article is here and it is long enough to be decided at once.<p>Be.
    <p>a<b>b</b> &lt;c&gt; &eacute;</p><form>your name and the like</form><section id="comments"><p>I think that this is the best of it all and so on</p></section></article>
    <aside>the side of the page is this and that</aside><footer>&copy; all</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & line\nThe text of the article is here and it is long enough to be decided at once.\nBe.\nab <c> é"
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    no_article = "<div><a href=x>Home</a> | <a href=y>About</a></div><h2>Title</h2><div>The text of the page is here and it is long enough to be kept as it is in one block of its own.</div><div>Ok.</div>"
    assert htmltext.main_text(no_article) == "Title\nThe text of the page is here and it is long enough to be kept as it is in one block of its own.\nOk."
    assert htmltext.main_text("<article><p>open <b>end &am") == "open end &am"


def test_figures_decide_where_names_say_nothing():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(4))
    prose = "<p>The text of the page is here and it is long enough to be decided at once by its words.</p>"
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=q>Buy it.</div><div class=z><h1>Head</h1>{prose}<p>Be.</p>{prose}<p>End.</p><div><a href=/r>Only one link here</a></div></div><div class=k>All of it, 1999</div></body>"
    blocks = htmltext.cut_blocks(page)
    htmltext.decide(blocks)
    text = "The text of the page is here and it is long enough to be decided at once by its words."
    assert [b.text for b in blocks if b.keep] == ["Head", text, "Be.", text, "End."]
    assert {b.text: b.why for b in blocks if "Link" in b.text or b.text in (text, "Buy it.", "Be.")} == {f"Link {i}": "links" for i in range(4)} | {text: "prose", "Buy it.": "inherited", "Be.": "inherited"}
    # In an article a list of links goes, with its heading; a paragraph that is one link stays.
    page = f"<article>{prose}<p><a href=/x>The report</a></p>{prose}<h2>More</h2><ul>{links}</ul></article>"
    assert htmltext.main_text(page) == f"{text}\nThe report\n{text}"
    # A wrapper that sounds like a margin does not lose the article; comments as articles are none.
    assert htmltext.main_text(f"<div class='layout with-sidebar'><article>{prose}</article></div>") == text
    assert htmltext.main_text(f"<main>{prose}</main><div id=comments><article>{prose}</article></div>") == text
    assert htmltext.main_text("<article><p>One.<p>Two.</article>") == "One.\nTwo."


def test_block_passes_equal_their_restatement():
    """Both passes said anew, block by block, over random blocks."""
    rng = random.Random(8)
    H = htmltext

    def restated(blocks):
        share = [b.link_chars / len(b.text) for b in blocks]

        def figures(i):
            b = blocks[i]
            if b.region < 0:
                return False
            if share[i] > H.MAX_LINKS:
                row = [j for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j].region == b.region and share[j] > H.LIST_LINKS]
                return False if b.region == 0 or share[i] > H.LIST_LINKS and row else None
            if len(b.text) < H.LONG_CHARS:
                return None
            words = re.findall(r"[^\W\d_]+", b.text.lower())
            stops = len([w for w in words if w in H.STOP_WORDS]) / len(words) if words else 0
            return True if stops >= H.STOP_SHARE else False if stops < H.LOW_STOP_SHARE and b.region == 0 else None

        one = [figures(i) for i in range(len(blocks))]

        def inherits(i):
            b = blocks[i]
            scopes = [lambda o: o.region == b.region] if b.region > 0 else [lambda o, x=x: x in o.boxes for x in b.boxes] + [lambda o: True]
            for n, within in enumerate(scopes):
                at = [j for j in range(len(blocks)) if one[j] is not None and within(blocks[j])]
                page = b.region == 0 and n == len(scopes) - 1
                if not at and not page:
                    continue
                if page and not any(o.region > 0 for o in blocks) and True not in one:
                    return True
                after = [j for j in at if j > i]
                if b.heading and after:
                    return one[after[0]]
                far = [(abs(i - j), one[j], blocks[j].tag) for j in at]
                if page:
                    far += [(i + 1, False, "")] * (not [j for j in at if j < i]) + [(len(blocks) - i, False, "")] * (not after)
                votes = [(k, tag) for d, k, tag in far if d == min(far)[0]]
                return all(k for k, _ in votes) or any(k and (not page or tag == b.tag) for k, tag in votes)
            return True

        return [inherits(i) if k is None else k for i, k in enumerate(one)]

    for _ in range(400):
        blocks = []
        for _ in range(rng.randint(1, 14)):
            n = rng.choice([1, 3, 20, 30])
            text = " ".join(rng.choice(["the", "of"]) if rng.random() < rng.choice([0, 0.2, 0.5]) else "xyzword" for _ in range(n))
            block = H.Block(rng.choice([-1, 0, 0, 0, 1, 2]), rng.random() < 0.2, tuple(rng.sample(range(1, 5), rng.randint(0, 3))), 0, rng.choice("pd"))
            block.text, block.link_chars = text, rng.choice([0, 0, len(text) // 2, len(text)])
            blocks.append(block)
        want = restated(blocks)
        H.decide(blocks)
        assert [b.keep for b in blocks] == want


def test_a_long_page():
    body = "<p>The text of the page is here and it is long enough to be decided at once.</p><p>Ok.</p>" * 20_000
    assert htmltext.main_text(f"<nav>menu</nav><article>{body}</article>").count("\n") == 39_999


def test_features_of_long_texts_by_windows():
    from boardlens.llm import toxicity

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde \n") for _ in range(n)) for n in (0, 3, 900, 5000, 40)] + [None, "x\0y"]
    whole = [np.concatenate(x) for x in zip(*[(r + a, f) for a, _, r, f in toxicity.present(pa.array(texts, pa.string()))])]
    size = toxicity._windows.__defaults__
    toxicity._windows.__defaults__ = (97,)
    try:
        parts = [np.concatenate(x) for x in zip(*[(r + a, f) for a, _, r, f in toxicity.present(pa.array(texts, pa.string()))])]
    finally:
        toxicity._windows.__defaults__ = size
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()

    def brute(t):
        t = " " + "".join(" " if ord(c) < 33 else c for c in (t or "").lower()) + " "
        grams = {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
        return len(grams)

    assert np.bincount(whole[0], minlength=len(texts)).tolist() == pytest.approx([brute(t) for t in texts], rel=0.01)


def test_ratios_sway_the_fit():
    """Scaled by ratios the fit differs from that on plain columns, and it is the minimum that a slow solver finds."""
    from boardlens.llm import toxicity

    rng = np.random.default_rng(2)
    x = (rng.random((300, 6)) < 0.4).astype(np.float32)
    y = (x @ np.array([2, 1, -1, 0, 0.5, 0]) + rng.normal(size=300) > 1).astype(np.float32)
    ratio = toxicity.naive_bayes_ratios(x[y == 1].sum(0), x[y == 0].sum(0), int(y.sum()), int((1 - y).sum())).astype(np.float32)

    def slow(x, l2):
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(20_000):
            g = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.5 * (x.T @ g / len(y) + l2 * w), b - 0.5 * g.mean()
        return w, b

    scaled = toxicity.logistic(x * ratio, y, l2=0.05, rounds=2000)
    want = slow((x * ratio).astype(float), 0.05)
    assert scaled[0] == pytest.approx(want[0], abs=1e-3) and scaled[1] == pytest.approx(want[1], abs=1e-3)
    plain = toxicity.logistic(x, y, l2=0.05, rounds=2000)
    assert np.abs(scaled[0] * ratio - plain[0]).max() > 0.05
    assert toxicity.naive_bayes_ratios(np.array([3.0, 0]), np.array([0, 3.0]), 4, 4) == pytest.approx([np.log(4), -np.log(4)])


def test_keys_of_long_texts_by_windows(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 30_000).astype(np.uint8)
    data[rng.random(len(data)) < 0.1] = 32
    data[5_000:9_000] = 98  # a word longer than a window
    start, end, _ = W.word_spans(data, np.array([0, len(data)]))
    whole = W.span_keys(data, start, end)
    monkeypatch.setattr(W, "CHUNK_BYTES", 1 << 9)
    assert (W.span_keys(data, start, end) == whole).all() and len(set(whole.tolist())) > 1000


def test_long_texts_come_in_windows(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcÄé1.-") for _ in range(rng.randint(1, 9))) + rng.choice(["", "\t", "\n "]) for _ in range(n)) for n in (900, 3, 0, 400, 6)] + [None, "x" * 2000, " " * 700]
    column = pa.array(texts, pa.string())
    coder = bpe.load(tokenizer_file("byte_bpe_50k.json"))

    def words():
        found: list[list] = [[] for _ in texts]
        for a, _, _, data, heads, start, end, row, keys in W.word_runs(column):
            for r, s, e, k in zip(row.tolist(), start.tolist(), end.tolist(), keys.tolist(), strict=True):
                found[a + r].append((s - int(heads[r]), e - int(heads[r]), bytes(data[s:e]), k))
        return found

    sets = lambda: [(a, n, row.tolist(), h.tolist(), size.tolist(), key.tolist()) for a, n, row, h, size, key in jaccard._sets(column)]
    flat = lambda runs: sorted((a + r, x, s, k) for a, _, row, h, size, key in runs for r, x in zip(row, h, strict=True) for s, k in [(size[r], key[r])])
    ids = lambda: [i for _, _, _, i in coder.encode(column)]
    whole = words(), flat(sets()), np.concatenate(ids()).tolist()
    monkeypatch.setattr(W, "CHUNK_BYTES", 256)
    monkeypatch.setattr(W.text_chunks, "__defaults__", (256,))
    assert (words(), flat(sets()), np.concatenate(ids()).tolist()) == whole
    assert len(list(W.word_runs(column))) > 20
    carried = [keys for *_, keys in W.word_runs(column, carry=3)]
    assert carried[1][:3].tolist() == carried[0][-3:].tolist()


def brute_stretch(item, text, d):
    """(equal words, words, first place, first item word) of the best stretch of one diagonal, by trying all."""
    at = range(max(0, -d), min(len(item), len(text) - d))
    best = (0, 0, 0, 0)
    for a in at:
        n = 0
        for b in range(a, at.stop):
            n += item[b] == text[b + d]
            score = n - 2 * (b + 1 - a - n)
            if score > best[0]:
                best = (score, b + 1 - a, a + d, a)
    score, long, place, first = best
    return (score + 2 * long) // 3, long, place, first


def test_overlaps_equal_all_alignments():
    """Every text against every item at every alignment; also short items, repeated words, several places."""
    rng = random.Random(23)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    items = [[word() for _ in range(n)] for n in (40, 25, 16, 13, 12, 11, 10, 9, 8, 7, 6, 5)] + [["go"] * 14]
    texts = []
    for k, item in enumerate(items):
        for gone in range(3):
            t = [word() for _ in range(60)]
            p = list(item)
            for g in range(gone):
                p[(2 + 5 * g + k) % len(p)] = "zz"
            t[20:20] = p
            if gone == 1:
                t[90:90] = p
            texts.append(t)
    texts += [["go"] * 40, [word() for _ in range(200)], []]
    index = decontaminate.SeedIndex(list(range(len(items))), [" ".join(i) for i in items])
    column = pa.array([" ".join(t) for t in texts])
    ((_, _, _, _, _, _, _, row, keys),) = list(W.word_runs(column, W.SPACE_PUNCT))
    got: dict = {}
    for r, i, n, long, place, first in decontaminate.apart(decontaminate.stretches(index, keys, row)):
        got.setdefault((r, i), []).append((n, long, place - int(np.searchsorted(row, r)), first))
    seen = 0
    for r, t in enumerate(texts):
        for i, item in enumerate(items):
            need = min(decontaminate.MIN_MATCH, -(-len(item) * 4 // 5))
            found = [x for d in range(-len(item), len(t)) if (x := brute_stretch(item, t, d))[0] >= need and x[0] >= decontaminate.MIN_IDENTITY * x[1]]
            if not found:
                assert (r, i) not in got
                continue
            mine = got.get((r, i), [])
            if (r, i) != (len(texts) - 3, len(items) - 1):
                assert sorted(x[0] for x in mine)[-1:] == [max(x[0] for x in found)], (r, i)
                taken: list[tuple] = []
                for n, long, place, first in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                    if all(place + long <= p or p + m <= place for _, m, p, _ in taken):
                        taken.append((n, long, place, first))
                assert sorted(mine) == sorted(taken), (r, i)
            seen += 1
    assert seen >= 2 * len(items)


def test_packing_plan_meets_demand_with_little_padding():
    rng = random.Random(3)
    demand = {c: rng.randint(1, 60) for c in rng.sample(range(1, 257), 120)}
    plan = packing.plan_patterns(demand, 256)
    got: dict[int, int] = {}
    for pattern, n in plan:
        assert sum(c * k for c, k in pattern.items()) <= 256
        for c, k in pattern.items():
            got[c] = got.get(c, 0) + k * n
    assert got == demand
    need = sum(c * n for c, n in demand.items()) / 256
    big = sum(n for c, n in demand.items() if c > 128)
    assert sum(n for _, n in plan) <= 1.03 * max(need, big) + 2
    assert packing.plan_patterns({}, 256) == [] and packing.plan_patterns({256: 3}, 256) == [({256: 1}, 3)]


def test_records_round_trip():
    raw = warc.make_record(7, "http://x/ y", "é".encode(), None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (back,) = warc.members(z.compress(raw) + z.flush())
    h, block = warc.parse_record(back)
    assert block.endswith("é".encode()) and h["WARC-Type"] == "response" and h["WARC-Target-URI"] == "http://x/y"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace("é".encode(), b"ab"))
    h, block = warc.parse_record(warc.make_record(8, None, b"long" * 9, 7))
    assert h["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n") and h["X-Refers-To-Key"] == "7"


def test_record_ids_and_large_records():
    raws = [warc.make_record(None, "u", b"x", None, i) for i in range(2)] + [warc.make_record(None, "u", b"y", None), warc.make_record(5, "u", b"z" * 300_000, None)]
    packed = b"".join((z := zlib.compressobj(0, zlib.DEFLATED, 31)).compress(r) + z.flush() for r in raws)
    assert list(warc.members(packed)) == raws
    assert len({warc.parse_record(r)[0]["WARC-Record-ID"] for r in raws}) == 4
    with pytest.raises(ValueError):
        list(warc.members(packed[:-9]))


def test_blobs_of_signatures_round_trip():
    rng = np.random.default_rng(3)
    node = np.concatenate([rng.integers(1, 40, 500).astype(np.uint64), np.full(70_000, 7, np.uint64)])
    sig = rng.integers(0, 1 << 62, len(node)).astype(np.uint64)
    part = (sig >> np.uint64(60)).astype(np.int64)
    got = {(int(a), int(b)) for _, blob in jaccard._pack(part, node, sig) for a, b in zip(*jaccard._unpack(blob), strict=True)}
    assert got == {(int(a), int(b) & ((1 << 40) - 1)) for a, b in zip(node, sig, strict=True)}


@pytest.mark.parametrize("size", [4, 7, 12, 40, 150])
@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_linked_sets_share_a_signature(size, share):
    """Every pair at the limit of similarity meets, however many members are common."""
    rng = np.random.default_rng(size)
    for trial in range(60):
        a = np.unique(W.mix(rng.integers(1, 1 << 60, size).astype(np.uint64)))
        s = len(a)
        gone = int(rng.integers(0, s // 4 + 1))
        both = s - gone
        new = 0
        while 100 * both >= jaccard.PERCENT * (s + new + 1):
            new += 1
        new = int(rng.integers(0, new + 1))
        if 100 * both < jaccard.PERCENT * (s + new):
            continue
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], W.mix(rng.integers(1, 1 << 60, new).astype(np.uint64) + np.uint64(1 << 61))]))
        common = np.sort(rng.permutation(a)[: int(share * s)])
        h = np.concatenate([a, b])
        row = np.repeat([0, 1], [len(a), len(b)])
        r, sig = jaccard.signatures(row, h, np.array([len(a), len(b)]), common)
        if len(a) == len(b) == both:
            continue
        assert set(sig[r == 0].tolist()) & set(sig[r == 1].tolist()), (size, share, trial)


def test_sketches_never_refute_a_link():
    rng = np.random.default_rng(1)
    for size in (5, 60, 300):
        for _ in range(40):
            a = W.mix(rng.integers(1, 1 << 60, size).astype(np.uint64))
            b = np.concatenate([a[rng.integers(0, size // 3 + 1) :], W.mix(rng.integers(1 << 61, 1 << 62, rng.integers(0, size)).astype(np.uint64))])
            x, y = jaccard._fold([jaccard.sketch(a), jaccard.sketch(b)])
            assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
