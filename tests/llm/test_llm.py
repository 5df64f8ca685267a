import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tesserae.llm import audio, chat, common, lattice, mixing, neighbours, packing, quality, queries, shingles, simhash, substring, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, key string, fp string"


def awkward(spark, rows=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(3)
    words = ["wort", "Über", "the", "of", "日本", "x,y", "ABC", "0"]
    long_ = " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(9000))
    texts = [None, "", " \t\n", "one", "a b c d", long_, long_, long_ + " end", "rep " * 200, "<|endoftext|> x" + "\x1c" + "y", *rows]
    data = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}", None, "t", "k", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[4], data[4], (None, "null id text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_audio(spark):
    df = awkward(spark)
    got = audio.decode_media(audio.store_media(df)).collect()
    wanted = collections.Counter()
    for r in df.collect():
        t = (r.text or "").encode()
        p = t + b" " * (-len(t) % 192 if t else 192)
        wanted[r.doc_id, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == wanted
    assert {r.feature.split()[0] for r in got} <= {"mulaw", "alaw", "adpcm"}
    assert audio.decode_media(audio.store_media(empty(spark))).count() == 0


def test_stored_forms(spark):
    df = awkward(spark)
    stored = audio.store_media(df).collect()
    media = spark.createDataFrame(stored, "doc_id long, n_bytes long, media binary")
    got = {(r.doc_id, r.media_sha256): r for r in audio.decode_media(media).collect()}
    for doc_id, _, wav in stored:
        r = got[doc_id, hashlib.sha256(wav).hexdigest()]
        tag, rate, data = audio.parse_wav(bytes(wav))
        if tag == audio.ADPCM:
            pcm = audio.adpcm_decode(np.frombuffer(data, np.uint8).reshape(-1, audio.UNIT + 4)).ravel().tolist()
        else:
            pcm = [int(audio.EXPAND[tag][b]) for b in data]
        out = []
        for i, x in enumerate(pcm):
            mid = 8192 + sum(int(h) * ((pcm[i - j] if i >= j else 0) + (pcm[i + 1 + j] if i + 1 + j < len(pcm) else 0)) for j, h in enumerate(audio.HALF))
            out += [x, max(-32768, min(32767, mid >> 14))]
        name = {6: "alaw", 7: "mulaw", 0x11: "adpcm"}[tag]
        wanted = f"{name} rate=16000 samples={len(out)} peak={max(map(abs, out))} rms={int((sum(x * x for x in out) / len(out)) ** 0.5)} crossings={sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))}"
        assert r.media_bytes == len(wav) and r.feature == wanted
        assert audio.parse_wav(bytes(r.pcm)) == (1, 16000, np.array(out, "<i2").tobytes())
    assert audio.store_pcm(media).count() == len(stored)


def test_long_media_in_pieces(monkeypatch):
    pcm = np.random.default_rng(0).integers(-32768, 32768, 5000).astype(np.int16)
    whole = audio.upsample(pcm), audio.measured(pcm)
    for piece in (1, 7, 4999, 5000):
        monkeypatch.setattr(audio, "PIECE", piece)
        assert (audio.upsample(pcm) == whole[0]).all() and audio.measured(pcm) == whole[1]


def test_codecs():
    assert audio.EXPAND[audio.MULAW][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.EXPAND[audio.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 24), dtype=np.uint8)
    got = audio.adpcm_decode(blocks)
    for b, out in zip(blocks, got, strict=True):
        value, index, wanted = int(np.array(b[:2]).view("<i2")[0]), min(88, int(b[2])), []
        wanted.append(value)
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + int(audio.MOVES[code & 7])))
                wanted.append(value)
        assert out.tolist() == wanted
    tone = (8000 * np.sin(np.arange(400) * 0.2)).astype(np.int16)
    up = audio.upsample(tone).astype(float)
    assert np.abs(up[40:-40] - (8000 * np.sin(np.arange(800) * 0.1))[40:-40]).max() < 150


@pytest.mark.parametrize("which", ["awkward", "documents", "empty"])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = {"awkward": awkward, "documents": documents, "empty": empty}[which](spark)
    tokenizer, wanted = Tokenizer.from_file(path), collections.Counter()
    for r in df.collect():
        wanted[r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    pieces = packing.pack(df, path, 50).collect()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    cut = collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    by_doc = collections.defaultdict(list)
    for (doc_id, ids), n in wanted.items():
        by_doc[doc_id].append((ids, n))
    assert sum(len(ids) // 4 * n for (_, ids), n in wanted.items()) == sum(p.length for p in pieces)
    for (doc_id, start, length, crc, total), _ in cut.items():
        assert any(len(ids) == 4 * total and zlib.crc32(ids[4 * start : 4 * (start + length)]) == crc for ids, _ in by_doc[doc_id])


def test_words_against_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    made = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(3000)) for letters, most in (("abcdefghijklmnopqrstuvwxyzéñßæаб", 60), ("aabcee'.-!1É", 12), ("ab", 40))]
    odd = ["<|ENDOFTEXT|>", "a<|EndOfText|>b", "<|STARTOFTEXT|>", "x<|endoftext|>Y", "<|endoftext|>", "<|", "İ", "ß", "ǅ", "Σ", "ς", "é", "e\u0301", "ª", "ŉ", "K", "'", "'S", "'ll", "/", "&", "TK", "abc", "Zy", "9", "-", "…", "日", "\u0307", "\x1c", "ԱՖ", "Ꮳ"]
    made += [" ".join("".join(rng.choice(odd) for _ in range(rng.randint(1, 5))) for _ in range(50)) for _ in range(400)]
    texts = ["", "Ärger's ab''c don't, x!!! 12a a1b2 ﬁne İstanbul ǅ 日本語 ß. e\u0301", " ".join("z" * k for k in range(1, 400, 7)), "'s '' a' 'a'b", "\x1c a b\u3000d", *made]
    whole = Tokenizer.from_file(path)
    words = packing.Words(path)
    for _ in range(2):  # once new, once known
        assert [x.tolist() for x in words(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]


def test_bm25_finds_related():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * k, 100 * k + 60, 300).astype(np.uint16) for k in (1, 2) for _ in range(5)]
    scores = packing.Index(topics).scores(0)
    assert scores[:5].min() > scores[5:].max()


def test_statistics_of_all_documents(spark):
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, int(rng.integers(1, 200))).clip(1, 900).astype("<u2") for _ in range(120)]
    cuts = [len(d) // 2 if i % 3 == 0 else 0 for i, d in enumerate(docs)]
    bodies = []
    for d, cut in zip(docs, cuts, strict=True):
        terms, n = np.unique(d[:cut], return_counts=True)
        bodies.append(terms.astype("<u2").tobytes() + n.astype("<u4").tobytes())
    rests = [d[cut:] for d, cut in zip(docs, cuts, strict=True)]
    rows = spark.createDataFrame([(bytearray(d.tobytes()), bytearray(b)) for d, b in zip(rests, bodies, strict=True)], "rest binary, body binary").repartition(5)
    stats = packing.statistics(rows)
    df, mean = collections.Counter(t for d in docs for t in set(d.tolist())), sum(map(len, docs)) / len(docs)
    part = docs[:40]
    for seed in (0, 7):
        wanted = [0.0] * len(part)
        for t in set(part[seed].tolist()):
            for i, d in enumerate(part):
                tf = d.tolist().count(t)
                wanted[i] += math.log(1 + (120 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(packing.Index(part, stats).scores(seed), wanted)
        assert np.allclose(packing.Index(rests[:40], stats, bodies[:40]).scores(seed), wanted)


def test_windows_are_filled_with_the_nearest_unused():
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.3, int(rng.integers(300, 2500))).clip(1, 3000).astype("<u2") for _ in range(60)]
    stats, left, wanted = packing.Statistics.of(docs), set(range(60)), []
    index, now = packing.Index(docs, stats), None
    while now is not None or left:
        seed, start = now or (min(left), 0)
        left.discard(seed)
        window, now, scores = [(seed, start, len(docs[seed]) - start)], None, index.scores(seed)
        space = packing.WINDOW - window[0][2]
        for d in sorted(left, key=lambda d: (-scores[d], d)):
            if not space:
                break
            left.discard(d)
            window.append((d, 0, min(space, len(docs[d]))))
            space -= window[-1][2]
            if window[-1][2] < len(docs[d]):
                now = d, window[-1][2]
        wanted.append(window)
    assert packing.fill(docs, stats) == wanted


def test_shards_hold_neighbours(spark):
    rng = random.Random(6)
    rows = []
    for topic in range(20):
        own = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(6)]
        rows += [(topic, " ".join([*(rng.choice(["the", "of", "and", "to", "in"]) for _ in range(60)), *own])) for _ in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    shards = collections.defaultdict(set)
    for p in packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 100).collect():
        shards[rows[p.doc_id][0]].add(p.sequence_id >> 32)
    assert len(set.union(*shards.values())) > 4 and sum(map(len, shards.values())) / len(shards) < 4


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, score double")


def test_rules(spark):
    given = ["http://WWW.Example.com/en/a?x", "http://example.com/en/a", "https://sub.example.com/EN/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/#f", "ftp://notcom/", None, "no url", "http://a.com", "x://H?q/://z", ""]
    got = {r.page_id: r for r in urls.judge(pages(spark, [(i, u, None, "h", 1.0) for i, u in enumerate(given)])).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(given))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en/a", "example.com/en/"), ("sub.example.com", "/EN/", "com/"), ("x.net", "/es/1", "net/es/"), ("x.net", "/es", None),
        ("net", "/fr/", "net/fr/"), ("notcom", "/", None), ("", "", None), ("", "", None), ("a.com", "", None), ("h", "", None), ("", "", None),
    ]
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[7].verdict == "allow"


def test_propagation(spark):
    hosts = {"good.com": ["a.org"], "a.org": ["b.org", "a.org"], "b.org": ["good.com"], "bad.net": ["c.org"], "c.org": ["bad.net"], "d.org": ["bad.net", "b.org"], "e.org": []}
    rows = [(i, f"http://{h}/fr/", "".join(f'<a class="x" href="//{t}/p">' for t in to), "h", 0.0) for i, (h, to) in enumerate(hosts.items())]
    got = {r.host: r for r in urls.judge(pages(spark, rows)).collect()}
    names = list(hosts)
    w = np.zeros((7, 7))
    for h, to in hosts.items():
        to = [t for t in to if t != h]
        for t in to:
            w[names.index(h), names.index(t)] = 1
    for field, seed, matrix in (("trust", "good.com", w), ("distrust", "bad.net", w.T)):
        step = matrix / np.maximum(1, matrix.sum(1, keepdims=True))
        s = np.array([float(n == seed) for n in names])
        wanted = np.linalg.solve(np.eye(7) - 0.85 * step.T, 0.15 * s)
        assert np.allclose([got[n][field] for n in names], wanted, atol=1e-4)
    assert got["c.org"].verdict == "block" and got["b.org"].verdict == got["e.org"].verdict == "allow"
    assert urls.judge(pages(spark, [])).count() == 0


def test_edges(spark):
    html = '<BASE href="//base.org/x"><a href="rel">1</a><a href="/top"><a href="http://U@Far.net:80/p"><area href=//c.base.org?q><a href="mailto:a@b.c"><a href="#here">'
    rows = [(0, "http://www.a.example.com:80/x", html, "h", 0.0), (1, "http://1.2.3.4/", '<a href="/x">', "h", 0.0), (2, "http://x.co.uk/", None, "h", 0.0)]
    got = {(r.src, r.dst): r.n for r in urls.host_edges(urls.with_host(pages(spark, rows).select("url", "html"))).collect()}
    up = [("www.a.example.com", "a.example.com"), ("a.example.com", "example.com"), ("c.base.org", "base.org")]
    assert got == {("www.a.example.com", "base.org"): 3, ("www.a.example.com", "far.net"): 1, ("www.a.example.com", "c.base.org"): 1} | {e: 1 for e in up} | {e[::-1]: 1 for e in up}


def test_scores_of_driver_pages(spark):
    """All of the driver's pages against the equations solved at once."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = urls.judge(df).collect()
    edges = urls.host_edges(urls.with_host(df)).collect()
    names = sorted({r.host for r in got} | {e.src for e in edges} | {e.dst for e in edges})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for e in edges:
        w[at[e.src], at[e.dst]] = e.n
    assert len(edges) > 20
    kinds = collections.defaultdict(list)
    verdict = dict(map(reversed, urls.RULES))
    for r in got:
        kinds[r.host].append(verdict.get(r.rule))
    score = {}
    for field, kind, matrix in (("trust", "allow", w), ("distrust", "block", w.T)):
        step = matrix / np.maximum(1, matrix.sum(1, keepdims=True))
        seed = np.array([kinds[n].count(kind) / len(kinds[n]) if n in kinds else 0.0 for n in names])
        score[field] = np.linalg.solve(np.eye(len(names)) - 0.85 * step.T, 0.15 * seed)
        assert np.allclose([getattr(r, field) for r in got], [score[field][at[r.host]] for r in got], rtol=1e-3)
    for r in got:
        t, d = score["trust"][at[r.host]], score["distrust"][at[r.host]]
        assert r.verdict == (verdict[r.rule] if r.rule else "block" if d - t > 0.05 * (d + t) else "allow")


@pytest.mark.parametrize("linkers", [1, 3, 300])
def test_verdicts_do_not_hang_on_the_number_of_linkers(spark, linkers):
    hosts = {"bad.net": [], "good.com": ["fine.org"], "fine.org": ["good.com"], "far.org": ["l0.org"], "alone.org": []} | {f"l{i}.org": ["bad.net"] for i in range(linkers)}
    rows = [(f"http://{h}/fr/", "".join(f'<a href="//{t}/p">' for t in to)) for h, to in hosts.items()]
    rows += [("http://mixed.net/fr/", None), *(("http://mixed.net/de/", None) for _ in range(3))]
    got = {r.host: r.verdict for r in urls.judge(pages(spark, [(i, *r, "h", 0.0) for i, r in enumerate(rows)])).where("path = '/de/' or host <> 'mixed.net'").collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.net", "mixed.net", "far.org", *(f"l{i}.org" for i in range(linkers))}


def test_chat(spark):
    turns = [("system", "be [INST] good"), ("user", "a\\b</s><|turn|>\n"), ("assistant", "<|end|>\n ok"), ("user", None), (None, "role"), ("assistant", ""), ("a\n\\b", "odd role")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, i, ("user", "assistant")[i % 2], "word " * (i % 37)) for i in range(300)] + [(3, None, "user", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (None, 1, "user", "n"), (4, 0, "assistant", "z" * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos long")
    for budget, history in ((300, 60), (40, 0), (1 << 20, 0)):
        cut = chat.windows(df, budget, history)
        for r in cut.collect():  # turns of a window cost at most the budget, but for a turn alone beyond it
            said = [regex.sub(r"(?s)\\(.)", r"\1", p[len(chat.TURN) :]) for p in r.formatted.split(chat.END)[:-1]]
            cost = sum(len(regex.findall(chat.TOKEN, s)) + chat.OVERHEAD for s in said)
            assert cost <= budget or r.formatted.count("<|turn|>") - r.n_context == 1
        got = {r.conv_id: r for r in chat.read_back(cut).collect()}
        for k in (1, 2, 3, 4, None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            assert got[k].turns == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own) and got[k].n_turns == len(own)
            assert got[k].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.windows(df.limit(0)).count() == 0
    assert chat.windows(df, 300, 60).where("conv_id = 2 and n_context > 0").count() > 5


def test_lattice(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = awkward(spark)
    rows = {(r.doc_id, r.n_tokens): r for r in lattice.score(df, path).collect()}
    count = collections.Counter()
    for r in df.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update([*(r.text or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    for r in df.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        g = rows[r.doc_id, len(words)]
        assert (g.train_tokens, g.n_known) == (n, sum(count[w] > 0 for w in words))
        assert math.isclose(g.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert g.score < 0 and math.isfinite(g.score)
    assert lattice.score(empty(spark), path).count() == 0


def test_marginals_against_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = lattice._pieces(path)
    log_p = np.log(pieces.prior)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {p: i for i, p in enumerate(known)}

    def total(s: str) -> float:
        if not s:
            return 1.0
        out = sum(math.exp(log_p[ids[s[:k]]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in ids)
        return out if s[0] in ids else out + math.exp(log_p[pieces.n]) * 256.0 ** -len(s[0].encode()) * total(s[1:])

    words = ["the", "hello", "größe", "𝔘x", "zq"]
    got = lattice.log_marginals([w.encode() for w in words], path, log_p)
    assert np.allclose(got, [math.log(total("▁" + w)) for w in words])
    out = np.zeros(pieces.n + 1)
    for at, lat in lattice.lattices([b"hello"], pieces, log_p):
        lat.expected(np.ones(len(at)), out)
    assert math.isclose(sum(out[i] * len(known[i]) for i in np.flatnonzero(out)), len("▁hello"))


def vocabulary(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: i for i, p in enumerate(known)}


def plain_lattice(word, ids, most, log_p):
    """Total and expected counts of a word by the textbook recursion."""
    s = "▁" + word
    arcs = [(a, b, ids[s[a:b]], log_p[ids[s[a:b]]]) for a in range(len(s)) for b in range(a + 1, min(len(s), a + most) + 1) if s[a:b] in ids]
    arcs += [(a, a + 1, len(ids), log_p[len(ids)] - math.log(256) * len(s[a].encode())) for a in range(len(s)) if s[a] not in ids]
    alpha, beta = [-math.inf] * (len(s) + 1), [-math.inf] * (len(s) + 1)
    alpha[0] = beta[-1] = 0.0
    for a, b, _, w in sorted(arcs, key=lambda x: x[1]):
        alpha[b] = np.logaddexp(alpha[b], alpha[a] + w)
    for a, b, _, w in sorted(arcs, key=lambda x: -x[0]):
        beta[a] = np.logaddexp(beta[a], beta[b] + w)
    count = collections.Counter()
    for a, b, i, w in arcs:
        count[i] += math.exp(alpha[a] + w + beta[b] - alpha[-1])
    return alpha[-1], count


def test_long_words_whole():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, ids, rng = lattice._pieces(path), vocabulary(path), random.Random(2)
    log_p = np.log(pieces.prior)
    words = ["".join(rng.choice("abcdehinorst𝔘ß日0123+/=") for _ in range(n)) for n in (254, 255, 256, 257, 400, 1500)] + ["ab" * 300]
    got, wanted = lattice.log_marginals([w.encode() for w in words], path, log_p), [plain_lattice(w, ids, pieces.most, log_p) for w in words]
    assert np.allclose(got, [t for t, _ in wanted], rtol=1e-9)
    for w, (_, count) in zip(words, wanted, strict=True):
        out = np.zeros(pieces.n + 1)
        for _, lat in lattice.lattices([w.encode()], pieces, log_p):
            lat.expected(np.ones(1), out)
        assert np.allclose(out, [count[i] for i in range(pieces.n + 1)], atol=1e-7)


def test_scores_against_the_textbook(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, ids = lattice._pieces(path), vocabulary(path)
    texts = ["the cat sat on the mat", "the dog 日本 sat", "", None, "x" * 300 + " cat", "Größe größe the", "unseen words here", "the the the"]
    docs = [(i, t) for i, t in enumerate(texts)]
    train = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), b""])
    total, once, ends = sum(train.values()), sum(n == 1 for n in train.values()), 1  # distinct words count once, the end too
    counts = pieces.prior * lattice.PRIOR
    for _ in range(lattice.EM_ROUNDS):
        log_p, counts = np.log(counts / (counts.sum() + ends + 1)), pieces.prior * lattice.PRIOR
        for w in train:
            if w:
                for i, n in plain_lattice(w.decode(), ids, pieces.most, log_p)[1].items():
                    counts[i] += n
    log_p, fresh = np.log(counts / (counts.sum() + ends + 1)), once * total / (total - once)
    end = math.log((ends + 1) / (counts.sum() + ends + 1))
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    for i, t in docs:
        wanted = 0.0
        for w in [*(t or "").encode().lower().split(), b""]:
            wanted += math.log10((train[w] + fresh * math.exp(plain_lattice(w.decode(), ids, pieces.most, log_p)[0] if w else end)) / (total + fresh))
        assert math.isclose(got[i], wanted, rel_tol=1e-7)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in got]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.93 * len(held)
    odd = quality.classify(awkward(spark), model).collect()
    assert len(odd) == awkward(spark).count() and all(0 <= r.score <= 1 for r in odd)
    flat = quality.train(docs, labels.limit(0))
    assert {r.predicted for r in quality.classify(docs.limit(5), flat).collect()} == {1}
    assert quality.classify(empty(spark), flat).count() == 0


def brute_neighbours(x, k=10, every=100):
    ids = sorted(x)
    v = np.array([x[i] for i in ids], float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            d = np.sqrt(((v - v[n]) ** 2).sum(1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if j != n][:k]
    return out


def test_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: r.embedding for r in rows}
    odd = [(90_000, None), (90_100, [0.0] * 64), (90_200, [None] * 64), (90_300, [math.nan] * 64), (90_400, [1.0]), (None, x[0]), *((100_000 + i, x[0]) for i in range(300))]
    x |= {i: v for i, v in odd if i is not None and i >= 100_000}
    df = spark.createDataFrame([(*r, 1) for r in [*((r.vec_id, r.embedding) for r in rows), *odd]], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.IntegerType())]))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wanted = brute_neighbours(x)
    assert set(got) == set(wanted)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in wanted.items()) >= 0.95 * sum(map(len, wanted.values()))
    assert [i for i, _ in got[0]] == [100_000 + i for i in range(10)]
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and all(math.isclose(s, math.dist(x[q], x[i]), abs_tol=1e-9) for i, s in found)
    assert neighbours.nearest(df.limit(0), 100).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(few, 100).orderBy("rank").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("noise", [1e-4, 1e-3])
def test_neighbours_among_near_copies(spark, noise):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    x = (one / np.linalg.norm(one) + noise * rng.standard_normal((2000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, 20).collect():
        got[r.query_id].add(r.vec_id)
    wanted = brute_neighbours(dict(enumerate(x)), every=20)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in wanted.items()) >= 0.9 * sum(map(len, wanted.values()))


def test_targets():
    assert mixing.targets([10, 120, 100]) == [20.0, 325 * 2 / 3, 325 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_mixing(spark, which):
    docs = {"awkward": awkward, "documents": documents}[which](spark)
    sizes = common.save(mixing.sized(docs).select("doc_id", "source", "_size", "_md5"), "t")
    placed, pieces, count = mixing.mix(sizes)
    taken = pieces.groupBy("_s").agg(F.sum("length").alias("n")).collect()
    wanted = {r._s: r.target for r in placed.select("_s", "target").distinct().collect()}
    assert all(abs(r.n - wanted[r._s]) < 1 for r in taken)
    rows = mixing.mixed(docs)
    words = {r.source: r.n for r in mixing.sized(rows).groupBy("source").agg(F.sum("_size").alias("n")).collect()}
    assert sum(words.values()) == sum(r.n for r in taken) and rows.columns == docs.columns
    assert {r.slot for r in pieces.select("slot").distinct().collect()} <= set(range(count))
    odd = docs.withColumn("_size", F.lit("x")).withColumn("_row", F.lit(7)).withColumn("c0", F.lit(1.5)).withColumn("_md5", F.lit(None).cast("string"))
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == rows.count()
    slots = mixing.schedule(spark, [3.0, 1.0, 4.0], 1).orderBy("slot").collect()
    assert [sum(r._s == s for r in slots) for s in range(3)] == [3, 1, 4]
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixed_follows_the_schedule(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(50 + i % 300)), "abc"[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2]) for i in range(12_000)]
    got = common.save(mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("p", F.spark_partition_id()), "t")
    words = [(r.source, len(r.text.split()), r.p) for r in got.orderBy("p").collect()]
    whole = {s: sum(n for x, n, _ in words if x == s) / sum(n for _, n, _ in words) for s in "abc"}
    parts_ = collections.defaultdict(collections.Counter)
    for s, n, p in words:
        parts_[p][s] += n
    assert len(parts_) > 4
    for c in parts_.values():
        assert all(abs(c[s] / c.total() - whole[s]) < 0.1 for s in "abc")


def test_schedule_is_even(spark):
    slots = [r._s for r in mixing.schedule(spark, [5e5, 2e5, 1e5], 1).orderBy("slot").limit(200_000).collect()]
    counts = np.cumsum(np.eye(3)[slots], 0)
    assert np.abs(counts - np.arange(1, len(slots) + 1)[:, None] * np.array([5, 2, 1]) / 8).max() < 8


def test_golay():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    errors = np.bitwise_count(simhash.ERRORS[simhash.syndrome(words)])
    assert errors.max() == 3
    for flips in (1, 2):
        other = words.copy()
        for b in range(flips):
            other ^= 1 << np.random.default_rng(b + 1).integers(11 * b, 11 * b + 11, 2000)
        a, b = simhash.segment_keys(words, 23), simhash.segment_keys(other, 23)
        for x, y in zip(a, b, strict=True):
            assert {*x[x >= 0]} & {*y[y >= 0]}
        if flips == 1:
            assert all(y[0] in x for x, y in zip(a, b, strict=True))


def by_pairs(fp):
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def test_links_against_pairs():
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fp = set(base)
    for b in base[:30]:
        for n in range(12):
            x = b
            for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(bit)
            fp.add(x)
    for _ in range(400):  # a crowd around one point
        x = base[0]
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            x ^= 1 << int(bit)
        fp.add(x)
    fp = sorted(fp)
    own = np.array(fp, np.uint64)
    forest = simhash.Forest(len(fp))
    for a, b in simhash.link(own, *simhash.fingerprint_keys(own)):
        assert (fp[a] ^ fp[b]).bit_count() <= 4
        forest.add(np.array([a]), np.array([b]))
    assert [forest.root(i) for i in range(len(fp))] == by_pairs(fp)


def test_fingerprint_by_majority():
    import xxhash

    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 6, 300):
        words = [rng.choice(["Aa", "bÉ", "c", "日本", "d,"]) for _ in range(n)]
        low = [w.encode().lower() for w in words]
        grams = [b" ".join(low[i : i + 4]) for i in range(max(1, n - 3))] if n else []
        wanted = sum(1 << b for b in range(64) if grams and 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))
        assert simhash.fingerprint("\t ".join(words).encode()) == wanted


def test_near_duplicates(spark):
    copies = [" ".join(f"w{i}" for i in range(400)) + f" tail{n}" for n in range(5)]
    df = awkward(spark, copies)
    got = simhash.near_duplicates(df).collect()
    source = df.collect()
    fps = [simhash.fingerprint((r.text or "").encode()) for r in source]
    roots = by_pairs(fps)
    least = {}
    for r, c in zip(source, roots, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, 1 << 60), r.doc_id)
    wanted = collections.Counter((r.doc_id, f, least.get(c)) for r, f, c in zip(source, fps, roots, strict=True))
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == wanted
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def jaccard_roots(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_representatives_by_similarity(spark):
    rng = random.Random(11)
    texts = []
    for k in range(12):  # copies with words changed here and there, on both sides of the bound, and one large group
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
        for _ in range(120 if k == 0 else 6):
            copy = list(words)
            for at in rng.sample(range(300), rng.randint(0, 14)):
                copy[at] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    common = [f"k{rng.randint(0, 10**6)}" for _ in range(40)]
    for n in range(80):  # unlike texts around a common passage, which crowd the keys of a few true pairs
        own = [f"u{rng.randint(0, 10**6)}" for _ in range(30 if n % 8 else 6)]
        texts.append(" ".join(own + common))
        if n % 8 == 0:
            texts.append(" ".join([*own[1:], "other", *common]))
    df = awkward(spark, texts)
    roots = jaccard_roots([r.text for r in df.collect()])
    kept = simhash.representatives(df, similarity=0.8)
    ids = {}
    for r, c in zip(df.collect(), roots, strict=True):
        ids[c] = min(ids.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(ids.values()) and kept.columns == df.columns
    assert simhash.representatives(df).count() > kept.count()
    odd = df.withColumn("_key", F.lit(1)).withColumn("_own", F.create_map(F.lit("a"), "doc_id")).withColumn("digest", F.lit(None).cast("string"))
    assert simhash.representatives(odd, similarity=0.8).count() == kept.count()
    docs = corpus_pipeline.unlike(spark, df, SF)
    assert docs.count() == kept.count()
    assert simhash.representatives(empty(spark), similarity=0.8).count() == 0


def test_representatives_start_from_golay_links(spark, monkeypatch):
    """Pairs that fingerprints link are candidates without any MinHash key, and what is not alike enough is dropped again."""
    rng = random.Random(4)
    words = [f"v{rng.randint(0, 10**6)}" for _ in range(400)]
    other = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words[:-1], "last"]), " ".join(other), "", " ".join([*other, *other[:1]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = shingles.sketches(rows, "doc_id", simhash.fingerprint)
    fp = {r.doc_id: r.fp for r in sketched.collect()}
    pairs = {(r.a, r.b) for r in shingles.near(sketched, simhash.links, 0.8).collect()}
    assert pairs == {tuple(sorted((fp[0], fp[2]))), tuple(sorted((fp[3], fp[5])))} and fp[0] == fp[1]
    monkeypatch.setattr(shingles, "_chained", lambda met: met.sparkSession.createDataFrame([], "a long, b long"))
    asked = []
    monkeypatch.setattr(simhash, "links", lambda fps, links=simhash.links: (asked.append(fps.count()), links(fps))[1])
    assert sorted(r.doc_id for r in simhash.representatives(rows, similarity=0.8).collect()) == [0, 3, 4] and asked


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and all(got[301 + i] == 300 for i in range(50))


def brute_substrings(texts, length):
    seen = collections.Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for w in texts:
        drop = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                drop[i : i + length] = [True] * length
        out.append((len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop, strict=True) if not d)).hexdigest()))
    return out


def test_blocks_take_a_partition_each(spark):
    rows = spark.range(5000).select(common.named_block(F.col("id") % 50).alias("b")).repartition(50, "b").select("b", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(rows) == len({r.p for r in rows}) == 50
    plan = spark.range(5).select(common.named_block(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000


@pytest.mark.parametrize("length, pairs", [(35, 64), (35, 3), (12, 64), (12, 0)])
def test_substrings(spark, length, pairs):
    rng = random.Random(7)
    shared = [[rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(n)] for n in (12, 34, 35, 36, 60, 120)]
    rows = []
    for _ in range(60):
        own = []
        for _ in range(4):
            own += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 25))] + rng.choice(shared)[rng.choice([0, 0, 5]) :]
        rows.append(" ".join(own))
    rows += ["p q " * 40, "z " * 34, "z " * 35, "z " * 36]
    df = awkward(spark, rows)
    got = substring.dedup_substrings(df, length=length, keep=("lang", "key"), pairs=pairs).collect()
    source = df.collect()
    wanted = brute_substrings([(r.text or "").encode().split() for r in source], length)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == collections.Counter((r.doc_id, *w) for r, w in zip(source, wanted, strict=True))
    assert all(sum(s["length"] for s in r.repeats) == r.n_removed for r in got)
    assert substring.dedup_substrings(empty(spark), length=length).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.save(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 0
        if name == "near_duplicates":
            roots = collections.defaultdict(list)  # five-word shingles at a similarity of 0.8, by all pairs
            for r, root in zip(before.collect(), jaccard_roots([r.text for r in before.collect()]), strict=True):
                roots[root].append(r.doc_id)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(map(min, roots.values()))
        if name == "repeated_passages":
            wanted = {r.doc_id: w for r, w in zip(before.collect(), brute_substrings([r.text.encode().split() for r in before.collect()], 35), strict=True)}
            assert {r.doc_id: len(r.text.split()) for r in docs.collect()} == {d: n - m for d, (n, m, _) in wanted.items() if m < n or n == 0}
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
