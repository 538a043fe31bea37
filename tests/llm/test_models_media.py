import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, toxicity, transport

TONGUES = {"aa": "kalo miro tasu neki", "bb": "thron gruf welsh bragd", "cc": "ixoatl quetzi tlamo xochi"}


def labelled(n, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        lang = sorted(TONGUES)[i % 3]
        rows.append((i, " ".join(rng.choice(TONGUES[lang].split(), 30)), lang))
    return rows


def test_languages_are_told_apart(spark):
    docs = spark.createDataFrame(labelled(300) + [(900, None, "aa"), (901, "", "aa"), (902, "12 !!", None), (903, "miro tasu", None)], "doc_id bigint, text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert len(rows) == 304
    held = [r for r in rows.values() if r.held_out and r.doc_id < 300]
    assert held and all(r.lang_pred == sorted(TONGUES)[r.doc_id % 3] for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(rows[i].lang_pred == "und" and rows[i].rejected for i in (900, 901, 902)) and rows[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(300)) and not {900, 901, 902} & {r.doc_id for r in kept.collect()}


def test_language_edge_cases(spark, docs, empty):
    rows = language_id.identify_documents(docs).collect()
    assert len(rows) == docs.count()
    assert language_id.identify_documents(empty).collect() == []
    alone = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in language_id.identify_documents(alone).collect()] == ["und"]


def test_subwords_keep_to_their_text():
    texts = ["", "ab", "ab cd", "é"]
    model = language_id.LanguageModel(["x"], np.ones((language_id.BUCKETS, 1)), np.zeros(1))
    from tessera.llm.common import text_bytes

    _, of = language_id.subwords(*text_bytes(pa.array(texts)))
    counts = np.bincount(of, minlength=4)
    assert counts[0] == 0 and counts[2] == 2 * counts[1]
    assert model.scores(pa.array([*texts, None])).tolist() == [[0.0], [1.0], [1.0], [1.0], [0.0]]


def test_rejection_is_calibrated():
    rows = labelled(300, 1)
    model = language_id.fit([t for _, t, _ in rows], [lang for *_, lang in rows])
    _, p = model.predict(pa.array([t for _, t, _ in rows]))
    assert (p >= model.reject).mean() > 0.99 and 0 < model.reject <= 0.5


def toxic_rows(n, seed=0):
    rng, rows = np.random.default_rng(seed), []
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    for i in range(n):
        words = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            for j in rng.integers(0, 40, 3):
                words[j] = f"vilex{rng.choice(list('abcdefghijklmnopqrstuvwxyz'))}{rng.choice(list('abcdef'))}"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxic_spellings_are_found(spark):
    rows = toxic_rows(800)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "waK WAk")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 803 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.5


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, labels).collect()] == [0.0] * docs.count()
    assert toxicity.score_documents(empty, labels).collect() == []


def test_the_sample_is_bounded_in_rows_and_bytes_and_learns_every_label(spark):
    from tessera.llm.sampling import sample_texts

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 100) as text", "concat('l', id % 300) as lang").repartition(3)
    labelled = docs.select("doc_id", "lang").withColumnRenamed("lang", "label")
    texts, labels = sample_texts(docs, labelled, 5, 1000)
    assert len(set(labels)) == 300 and len(texts) == len(labels) < 300 * 10
    texts, labels = sample_texts(docs, labelled, 5, 250)
    assert max(labels.count(x) for x in set(labels)) == 2 and len(set(labels)) == 300
    assert sample_texts(docs, labelled, 5, 99) == ([], [])


def test_language_scores_against_brute_force():
    """The average of the texts' n-gram rows, but for whole words with both boundaries, one by one, through the linear softmax."""
    rng = np.random.default_rng(5)
    table, weights, bias = rng.normal(size=(language_id.BUCKETS, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    model = language_id.LanguageModel(["aa", "bb", "cc"], table @ weights, bias, temperature=1.7)
    texts = ["Kalo MIRO, x", "a", "  ", "été 12 ünd", "tasu " * 900]

    def bucket(gram):
        code = np.array([int.from_bytes(gram, "little")], np.uint32)
        mixed = (code ^ np.uint32(len(gram) * 0x1000193)) * np.uint32(0x9E3779B1)
        return int((((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> np.uint32(16))[0])

    best, p = model.predict(pa.array(texts))
    for i, text in enumerate(texts):
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
        found = [bucket(w[j : j + n]) for word in raw.split() for w in [b" " + word + b" "] for n in language_id.ORDERS for j in range(len(w) - n + 1) if (w[j], w[j + n - 1]) != (32, 32)]
        logits = (np.mean([table[k] for k in found], axis=0) if found else np.zeros(4)) @ weights + bias
        e = np.exp((logits - logits.max()) / 1.7)
        assert best[i] == logits.argmax() and p[i] == pytest.approx((e / e.sum()).max(), abs=1e-9)


class BruteKneserNey:
    """The toxicity operator's rules, by dictionaries."""

    def __init__(self, ordinary, toxic):
        self.pairs, self.spell, grams = [Counter(), Counter()], [Counter(), Counter()], set()
        for k, texts in enumerate((ordinary, toxic)):
            for text in texts:
                words = self.words(text)
                self.pairs[k].update(set(zip([None, *words], words, strict=False)))
                for w in set(words):
                    self.spell[k].update(self.spelling(w))
        grams = set(self.spell[0]) | set(self.spell[1])
        self.alphabet = max(2, len({g[-1] for g in grams}))
        self.lower = {}
        for order in range(toxicity.CONTEXT, 0, -1):
            grams_below = Counter(g[1:] for g in grams)
            self.lower[order], grams = grams_below, set(grams_below)

    @staticmethod
    def words(text):
        return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in text.encode()).split()

    @staticmethod
    def spelling(word):
        padded = b"\x00" * toxicity.CONTEXT + word + b"\x01"
        return [padded[i : i + toxicity.CONTEXT + 1] for i in range(len(word) + 1)]

    @staticmethod
    def left(n):
        return 0 if n == 0 else n - (toxicity.ONCE if n == 1 else toxicity.TWICE if n == 2 else 2 * toxicity.DISCOUNT)

    def shared(self, gram):
        p = 1 / self.alphabet
        for order in range(1, toxicity.CONTEXT + 1):
            own = gram[-order:]
            followers = {g: n for g, n in self.lower[order].items() if g[:-1] == own[:-1]}
            if followers:
                p = (max(followers.get(own, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(followers) * p) / sum(followers.values())
        return p

    def top(self, counts, key, head, back):
        own = {g: n for g, n in counts.items() if g[:-1] == head}
        if not own:
            return back
        return (self.left(own.get(key, 0)) + sum(n - self.left(n) for n in own.values()) * back) / sum(own.values())

    def evidence(self, text):
        words, total = self.words(text), 0.0
        for v, w in zip([None, *words], words, strict=False):
            p = []
            for k in (0, 1):
                spelled = np.prod([self.top(self.spell[k], g, g[:-1], self.shared(g)) for g in self.spelling(w)])
                p.append(self.top(self.pairs[k], (v, w), (v,), spelled))
            total += np.log((1 - toxicity.SHARE) + toxicity.SHARE * p[1] / p[0])
        return total / max(1, len(words))


def test_toxicity_against_brute_force_kneser_ney():
    ordinary = ["the cat sat on the mat", "The dog; the cat", "go on home", "été the end", ""]
    toxic = ["you vile cat", "the vile vile dog", "go away you", "vileness on the mat"]
    model, brute = toxicity.count_models(ordinary, toxic), BruteKneserNey(ordinary, toxic)
    texts = ["", "the vile cat", "go away", "unheard zzz of", "THE mat, the viler dog", "you you you", "... !", "cat " * 300]
    got = model.evidence(pa.array(texts), {})
    assert got == pytest.approx([brute.evidence(t) for t in texts], abs=1e-9)
    assert got[0] == got[6] == 0 and got[1] > got[0] and model.evidence(pa.array([None, "the vile cat"]), {})[1] == pytest.approx(got[1])


def test_an_expression_of_two_harmless_words_is_found(spark):
    """Both words are frequent in both classes; only together do they mark a text."""
    rng, rows = np.random.default_rng(2), []
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    for i in range(800):
        words, bad = list(rng.choice(plain, 40)), i % 4 == 0
        for j in (5, 15, 25):
            words[j : j + 2] = ["get", "lost"] if bad else ["lost", "get"]
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97


@pytest.mark.parametrize("n", [1, 100, 161, 162, 175, 176, 177, 183, 184, 185, 5000, 32640, 32641, 300001])
def test_transport_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stream = transport.mux(payload)
    got = transport.demux(stream)
    units = -(-n // transport.UNIT)
    assert got.payload == payload and got.continuity_errors == 0 and len(stream) % 188 == 0
    assert got.pts == [k * transport.TICKS for k in range(units)] and got.random_access == list(range(0, units, transport.KEY))


def test_damage_is_seen():
    stream = transport.mux(bytes(5000))
    assert transport.demux(stream[: 188 * 4] + stream[188 * 5 :]).continuity_errors == 1
    with pytest.raises(ValueError):
        transport.demux(stream[:-1])
    with pytest.raises(ValueError):
        transport.demux(stream[:10] + bytes([stream[10] ^ 1]) + stream[11:])
    with pytest.raises(ValueError):
        transport.demux(b"\x00" + stream[1:])


def test_tables_that_span_packets_are_read():
    """A stream put together here, packet by packet: a program table with descriptors of 300 bytes, other streams beside."""

    def section(table, body):
        head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, 0, 1, 0xC1, 0, 0]) + body
        return head + transport.crc32_mpeg(head).to_bytes(4, "big")

    def packets(pid, data, counter=0):
        out = []
        while data or not out:
            piece, data = data[:184], data[184:]
            out.append(bytes([0x47, (0 if out else 0x40) | pid >> 8, pid & 255, 0x10 | counter & 15]) + piece.ljust(184, b"\xff"))
            counter += 1
        return out

    pes = lambda payload, pts: b"\x00\x00\x01\xbd" + (len(payload) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1]) + payload
    pat = packets(0, b"\x00" + section(0, bytes([0, 9, 0xE1, 0x23])))
    info = bytes([5, 150]) + bytes(150) + bytes([5, 146]) + bytes(146)
    pmt = packets(0x123, b"\x00" + section(2, bytes([0xE0, 0x50, 0xF0 | len(info) >> 8, len(info) & 255]) + info + bytes([6, 0xE0, 0x50, 0xF0, 0])))
    assert len(pmt) == 2
    body = pes(b"a" * (184 - 14), 7) + pes(b"b" * (2 * 184 - 14), (1 << 33) - 1)
    first, second = packets(0x50, body[:184]), packets(0x50, body[184:], 1)
    noise = packets(0x60, b"noise")
    got = transport.demux(b"".join([*pat, pmt[0], *noise, pmt[1], *first, *noise, *second]))
    assert (got.program, got.pid, got.stream_type, got.continuity_errors) == (9, 0x50, 6, 0)
    assert got.payload == b"a" * 170 + b"b" * 354 and got.pts == [7, (1 << 33) - 1]


def test_media_digest(docs, empty):
    text = dict(docs.select("doc_id", "text").collect())
    rows = transport.media_digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        media = transport.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    by_text = {}
    for r in rows:
        by_text.setdefault(text[r.doc_id] or "", set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert transport.media_digest(empty).collect() == []


def test_a_document_on_many_rows_comes_to_the_sample_once(spark):
    from tessera.llm.sampling import sample_texts

    rows = spark.range(6000).selectExpr("cast(3 as bigint) as doc_id", "'the same' as text").union(spark.range(40).selectExpr("id + 10", "concat('t', id)"))
    labels = rows.select("doc_id").distinct().selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    texts, marks = sample_texts(rows, labels, 1000, 1 << 20)
    assert texts.count("the same") <= 1 and len(texts) == len(set(texts)) == len(marks) > 20


def test_stored_index_lets_a_reader_seek(spark):
    """The index columns are what the stream itself says, and units of a range of time are read from a cut of it."""
    unit = transport.UNIT
    rows = [(0, None), (1, "short"), (2, "".join(chr(97 + i % 26) for i in range(unit * 21 + 5))), (3, "z" * unit)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    stored = transport.store_media(docs)
    for r in stored.collect():
        d = transport.demux(bytes(r.media))
        assert list(r.pts) == d.pts and list(r.random_access) == d.random_access
        for k, at in zip(r.random_access, r.access_bytes, strict=True):
            packet = bytes(r.media)[at : at + 188]
            assert packet[0] == 0x47 and packet[1] & 0x40 and packet[3] & 0x20 and packet[5] & 0x40 and k % transport.KEY == 0
    ticks = transport.TICKS
    for begin, end in ((0, 1), (9 * ticks, 12 * ticks), (7 * ticks + 1, 17 * ticks), (0, 99 * ticks), (21 * ticks, 22 * ticks), (500 * ticks, 600 * ticks), (5, 5)):
        got = {r.doc_id: (r.first_pts, r.n_units, bytes(r.data)) for r in transport.read_range(stored, begin, end).collect()}
        want = {}
        for i, text in rows:
            data = transport.payload_of(text)[1]
            units = [data[a : a + unit] for a in range(0, len(data), unit)]
            inside = [k for k in range(len(units)) if begin <= k * ticks < end]
            if inside:
                want[i] = (inside[0] * ticks, len(inside), b"".join(units[k] for k in inside))
        assert got == want
    assert transport.read_range(transport.store_media(docs.where("false")), 0, 9).collect() == []
