"""Packing, chat windows, audio, PII, language id, toxicity and URL lists: round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern.llm import audio, chat, langid, packing, pii, queries, toxicity, urlfilter
from postern.llm.tokens import Ids

DOCS = "doc_id long, text string"
SAMPLE = "/root/testdata/sf0.01"


def texts(n, seed=0):
    draw = random.Random(seed)
    return [(k, " ".join(f"word{draw.randrange(900)}" for _ in range(draw.choice([0, 1, 5, 40, 300, 1500])))) for k in range(n)]


# -- packing ---------------------------------------------------------------------------------------


def test_each_id_lies_in_one_piece(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = texts(120) + [(900, None), (901, ""), (5, "<|endoftext|> ünï 😀"), (5, "<|endoftext|> ünï 😀"), (None, "x"), (902, "a<|endoftext|>b"), (903, "<|endoftext|><|endoftext|> <|endoftext"), (904, "\n <|endo<|endoftext|>text|>")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, DOCS), with_ids=True).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.doc_tokens, tuple(p.ids)))
        by_seq[p.sequence_id].append(p)
    for i, found in by_doc.items():
        all_ids = sorted(x for _, ids in want.elements() if _ == i for x in ids)
        assert sorted(x for _, _, ids in found for x in ids) == all_ids
        if sum(n for (j, _), n in want.items() if j == i) == 1:
            assert tuple(x for _, _, ids in sorted(found) for x in ids) == next(ids for j, ids in want if j == i)
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at == found[0].sequence_length
    used = sum(p.length for p in pieces)
    padded = sum(n if (n := s[0].sequence_length) & (n - 1) == 0 else 1024 for s in by_seq.values())
    assert padded <= 1.02 * used
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_are_those_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    draw = random.Random(11)
    bits = ["a", " ", end, end[:-1], end[1:], "\n", "é", "😀", "<|", "|>", "endoftext", "12", "'s", "\xad", "  ", "\u3000", "\x00", "日本"]
    cases = [f"a{end}b", end, end + end, end[:-1], f" {end} ", ""] + ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(2000)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Ids().encode(cases[0].encode()).tolist() == [64, 50256, 65]
    for plain in (False, True):
        tok.encode_special_tokens = plain
        ids = Ids(plain=plain)
        for t in cases:
            assert ids.encode(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_step_groups_are_balanced(spark):
    pieces = packing.pack_documents(spark.createDataFrame(texts(300, 4), DOCS).coalesce(1)).collect()
    steps = Counter()
    for p in pieces:
        steps[p.step_group] += p.length
    assert all(n <= packing.STEP for n in steps.values())
    assert sum(n == packing.STEP for n in steps.values()) >= len(steps) - 1


# -- chat ------------------------------------------------------------------------------------------


def turns_of(n, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 2:
            rows.append((c, 0, "system", "be kind <|im_end|>"))
        for k in range(1, draw.randrange(2, 30)):
            rows.append((c, k, "user" if k % 2 else "assistant", " ".join(f"t{draw.randrange(99)}" for _ in range(draw.choice([0, 3, 60, 400])))))
    return rows


def test_windows_read_back(spark):
    odd = [(-1, 0, "user", queries.ESCAPED), (-1, 1, "assistant", queries.ESCAPED), (70, None, None, None), (71, 0, "assistant", "<\\|im_end|> <\\\\| < | <|"), (71, 0, "assistant", "<\\|im_end|> <\\\\| < | <|"), (72, 0, "a\nb\\<|im_end|>", "x"), (None, 1, "assistant", "😀\n")]
    rows = turns_of(20, 2) + odd
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, budget=300, history=80)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by_conv = defaultdict(list)
    for c, k, role, text in rows:
        by_conv[c].append((k is not None, k or 0, role or "", text or ""))
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    ids = Ids()
    many = spark.createDataFrame([(1, k, "user", "x") for k in range(2000)], frame.schema)
    most = max(w.n_turns for w in chat.format_windows(many, budget=1 << 20, history=0).collect())
    assert most == 2000  # the budget alone ends a window
    for w in windows.collect():
        assert w.n_tokens <= 300 or w.over_budget
        assert ids.count(w.formatted) <= w.n_tokens + 2 * w.n_turns
        if w.conv_id is not None and w.conv_id < 20 and w.conv_id % 2 and w.window:
            assert chat.parse(w.formatted)[0][0] == "system"
    assert chat.read_back(chat.format_windows(frame.limit(0))).count() == 0


# -- audio -----------------------------------------------------------------------------------------


def test_companding_tables():
    for tag, table in audio.TABLES.items():
        assert len(set(np.abs(table.astype(int)).tolist())) == 128
        assert sorted(table.tolist()) == sorted((-table.astype(int)).tolist()), tag
    assert (int(audio.TABLES[audio.MULAW][0]), int(audio.TABLES[audio.MULAW][255])) == (-32124, 0)
    assert (int(audio.TABLES[audio.ALAW][0xD5]), int(audio.TABLES[audio.ALAW][0xAA])) == (8, 32256)


def test_adpcm_blocks_equal_a_loop():
    data = np.random.default_rng(1).integers(0, 256, 5 * 64, dtype=np.uint8)
    data = data.reshape(5, 64)
    data[:, 2] %= 89
    want = []
    for block in data:
        value, index = struct.unpack("<h", block[:2].tobytes())[0], int(block[2])
        want.append(value)
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(audio.SHIFTS[code])))
                want.append(value)
    assert audio.decode_ima(data.tobytes() + b"short", 64).tolist() == want


def test_resampling_equals_a_loop():
    x = np.random.default_rng(5).integers(-32768, 32768, 90).astype(np.int16)
    for rate in (16000, 11025, 4000, 6000, 700):
        up, down = rate // np.gcd(8000, rate), 8000 // np.gcd(8000, rate)
        wide = 16 * max(up, down)
        t = np.arange(-wide, wide + 1)
        taps = np.rint((1 << audio.TAP_BITS) * np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1] * min(1.0, up / down)).astype(int)
        for n in (1, 5, 90):
            want = []
            for m in range(-(-n * up // down)):
                total = sum(int(x[i]) * int(taps[m * down - i * up + wide]) for i in range(n) if 0 <= m * down - i * up + wide < len(taps))
                want.append(max(-32768, min(32767, (total + (1 << audio.TAP_BITS - 1)) >> audio.TAP_BITS)))
            assert audio.resample(x[:n], 8000, rate).tolist() == want


def test_clips_decoded_together_equal_each_by_itself():
    draw = np.random.default_rng(6)
    clips = [(draw.integers(0, 256, n, dtype=np.uint8).tobytes(), block) for n, block in ((0, 64), (64, 64), (640, 64), (100, 36), (147, 36), (65, 64), (10, 3), (128, 64))]
    for clip, got in zip(clips, audio.decode_many(clips), strict=True):
        alone = audio.decode_many([clip])[0]
        assert str(got) == str(alone) if isinstance(got, ValueError) else got.tolist() == alone.tolist()


def test_resampling_keeps_a_tone(spark):
    t = np.arange(8000)
    x = np.rint(8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    y = audio.resample(x, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y[200:-200] - want[200:-200]).max() < 80
    clips = [(1, audio.write_wave(x.astype("<i2").tobytes(), audio.PCM, block=2, bits=16)), (2, b"junk"), (3, None), (4, audio.write_wave(b"", audio.ALAW))]
    out = {r.i: r for r in audio.expand_audio(spark.createDataFrame(clips, "i int, media binary")).collect()}
    assert (out[1].n_samples, out[2].pcm, out[3].pcm, out[3].audio_error, out[4].n_samples) == (16000, None, None, None, 0)
    assert out[2].audio_error


def test_texts_as_clips(spark):
    rows = [(1, None), (2, ""), (3, "ü" * 32), (4, "a" * 65), (5, "a" * 65), (6, "x" * 700_000)] + [(7 + k, f"text {k} " * k) for k in range(30)]
    out = audio.store_texts(spark.createDataFrame(rows, DOCS), with_media=True)
    again = audio.expand_audio(out.select("doc_id", "media"), rate=audio.OUT_RATE).collect()
    stored = {r.doc_id: r for r in out.collect()}
    assert {r.doc_id: bytes(r.pcm) for r in again} == {i: bytes(r.pcm) for i, r in stored.items()}
    assert stored[4].feature == stored[5].feature
    assert {audio.read_wave(bytes(r.media))[0] for r in stored.values()} == set(audio.FORMATS)
    for r in stored.values():
        b = (dict(rows)[r.doc_id] or "").encode()
        padded = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert audio.read_wave(bytes(r.media))[3] == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())


# -- personal data ---------------------------------------------------------------------------------


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_a_last_short_ima_block_is_decoded(spark):
    data = np.random.default_rng(4).integers(0, 256, 64 * 3, dtype=np.uint8).tobytes()
    short = data[128:148]
    want = np.concatenate([audio.decode_ima(data[:128], 64), audio.decode_ima(short, 20)])
    clips = [data[:148], short, data[:130], data[:132], data[:128], b""]
    rows = [(k, audio.write_wave(c, audio.IMA, block=64, bits=4)) for k, c in enumerate(clips)]
    out = {r.i: r for r in audio.expand_audio(spark.createDataFrame(rows, "i int, media binary"), rate=8000).collect()}
    assert np.frombuffer(out[0].pcm, "<i2").tolist() == want.tolist()
    assert [out[k].n_samples for k in range(6)] == [2 * 121 + 33, 33, None, 2 * 121 + 1, 2 * 121, 0]
    assert "header" in out[2].audio_error and out[1].audio_error is None


def test_base_spans_equal_the_patterns():
    draw = random.Random(8)
    parts = ["a.b@c-d.example", "@", "@@", "x@y", "10.0.0.255", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49", "0", "7", " ", "-", ".", "+", "é", "😀", "word", "%_", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        assert [s[:3] for s in pii.base_spans(text)] == plain_spans(text), text
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1." * 100_000)[:1] == [(0, 1, 7, "1.1.1.1")]


def test_disclosing_terms_are_found_and_redacted(spark):
    rows = [(k, f"please ask Zanzibarov at z@corp.example about item {'abcdefghij'[k]}ppp now") for k in range(8)]
    rows += [(100 + k, f"plain filler text about nothing number {k} please ask again about item now") for k in range(900)] + [(2000, None), (2001, "")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[0][1]
    lo = text.index("Zanzibarov")
    assert f"term:{lo}:{lo + 10}" in out[0].spans and "email:" in out[0].spans
    assert not re.search(r"term:%d:" % text.index("please"), out[0].spans)
    assert out[150].spans == "" and out[2000].n_email == 0
    assert out[0].clean_text.startswith("please ask [TERM] at [EMAIL] about item ") and out[150].clean_text == dict(rows)[150]
    assert out[2000].clean_text is None and out[2001].clean_text == ""
    lots = {r.doc_id: (r.spans, r.clean_text) for r in pii.sanitise(spark.createDataFrame(rows, DOCS), lot=2).collect()}
    assert lots == {i: (r.spans, r.clean_text) for i, r in out.items()}
    assert pii.redact(text, [(s.s, s.k, s.f) for s in out[0].span_list]).startswith("please ask [TERM] at [EMAIL]")
    want = {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t or "")) for i, t in rows}
    assert all(out[i].base_sha256 == hashlib.sha256(w.encode()).hexdigest() for i, w in want.items())
    extra = spark.createDataFrame([(1, "a@b.example", 4, 5)], "doc_id long, text string, rid int, near int")
    assert (r := pii.sanitise(extra).first()).rid == 4 and r.near == 5 and r.n_email == 1
    assert pii.sanitise(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_count_whole_rows_and_are_marked_everywhere(spark):
    filler = "these words stand between without end " * 3
    rows = [(k, f"Zanzibarov {filler} wrote to z@corp.example and then Zanzibarov left") for k in range(12)]
    rows += [(50, "Zanzibarov alone, zanzibarov again")] + [(100 + k, f"plain text {filler} here, then wrote and left") for k in range(300)]
    out = {r.doc_id: [s.s for s in r.span_list if s.k == 4] for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[0][1]
    assert out[0] == [0, text.rindex("Zanzibarov")]
    assert out[50] == [0, 18] and out[150] == []
    # an entity in a third of few rows
    often = [(k, "Quillington speaks hot@corp.example" if k < 30 else "other people speak here") for k in range(90)]
    out = {r.doc_id: r.spans for r in pii.sanitise(spark.createDataFrame(often, DOCS)).collect()}
    assert "term:0:11" in out[0] and out[60] == ""


# -- language and toxicity -------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95
    assert r.score.between(0, 1).all()
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", "en"), (4, "日本", None), (5, "the cat is on the mat", "en"), (5, "the cat is on the mat", "en"), (7, "der hund ist nicht hier", "de")]
    small = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.identify(small).where("doc_id <= 3").collect()} == {"und"}
    assert {x.lang_pred for x in langid.identify(small.where("lang is null")).collect()} == {"und"}
    assert langid.identify(small.limit(0)).count() == 0


def test_training_ignores_held_out_labels(spark):
    rows = [(k, f"{'abc de fgh' if k % 2 else 'xyz uv wrst'} {k}", "a" if k % 2 else "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spoilt = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d).collect()) for d in (docs, spoilt))
    assert a == b and all(p == ("a" if i % 2 else "x") for i, p, _ in a)


def test_landmarks_keep_all_their_ngrams():
    draw = np.random.default_rng(3)
    alphabets = {lang: [chr(c) for c in range(a, a + 2500)] for lang, a in (("x", 0x4E00), ("y", 0x5E00), ("z", 0xAC00))}
    rows = [(lang, "".join(draw.choice(abc, 600)).encode()) for lang, abc in alphabets.items() for _ in range(60)]
    model = langid.fit(rows)
    seen = np.unique(np.concatenate([langid.grams(s) for _, t in rows for s in langid.segments_of(t)]))
    assert len(model.known) == len(model.weights) > 60_000 // 2 and set(seen) >= set(model.known)
    assert model.known.max() == seen.max()  # single bytes have the highest codes
    new = [(lang, "".join(draw.choice(abc, 300)).encode()) for lang, abc in alphabets.items() for _ in range(5)]
    assert model.scorer()([t for _, t in new])[0] == [lang for lang, _ in new]
    rough = draw.integers(97, 123, (300, 2000)).astype(np.uint8)
    wide = langid.fit([("a", bytes(r)) for r in rough] + [("b", bytes(draw.integers(128, 256, 2000).astype(np.uint8))) for _ in range(60)])
    assert len(wide.known) > 60_000 and wide.known.max() == (1 << 24) + (1 << 16) + 255


def test_kernel_ridge_equals_the_dual_by_brute_force():
    draw = random.Random(21)
    vocab = {"a": ["alpha", "beta", "gamma"], "b": ["delta", "beta", "zeta"], "c": ["xi", "omega", "gamma"]}
    rows = [(lang, " ".join(draw.choice(w) for _ in range(6)).encode()) for lang, w in vocab.items() for _ in range(8)]
    model = langid.fit(rows, landmarks=8)  # every text is a landmark: the kernel is exact up to its rank
    sets = [{bytes(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)} for _, t in rows]
    k = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    gram = np.array([[k(x, y) for y in sets] for x in sets])
    langs = sorted(vocab)
    target = np.array([[1.0 if lang == name else -1.0 for name in langs] for lang, _ in rows])
    centre = np.eye(len(rows)) - 1 / len(rows)
    values, vectors = np.linalg.eigh(gram)
    rank = int((values > 1e-8 * values.max()).sum())
    alpha = np.linalg.solve(centre @ gram @ centre + langid.RIDGE * len(rows) * np.eye(len(rows)) / rank, centre @ target)
    new = [b"alpha delta beta", b"xi gamma omega gamma", rows[3][1]]
    known = set().union(*sets)
    presence = langid.Presence(model.known)
    for t in new:
        x = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} & known
        near = np.array([k(x, s) for s in sets])
        want = target.mean(axis=0) + (near - gram.mean(axis=0)) @ centre @ alpha
        row = presence.rows(langid.segments_of(t))
        got = (row @ model.weights) / np.sqrt(row.sum()) + model.bias
        assert np.abs(got[0] - want).max() < 2e-3
        assert model.scorer()([t])[0] == [langs[int(want.argmax())]]


def test_severity_is_the_likeliest_ordinal_model():
    draw = np.random.default_rng(9)
    rows = [(int(draw.integers(0, 3)), [k for k in range(3) if draw.random() < 0.5]) for _ in range(200)]
    l2 = 1e-2
    model = toxicity.fit(rows, [b"p", b"q", b"r"], l2=l2, steps=3000)

    def loss(w, cuts):
        total = 0.0
        for grade, at in rows:
            z = sum(w[k] for k in at)
            above = [1.0, *(1 / (1 + np.exp(-(z - c))) for c in cuts), 0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total / len(rows) + l2 / 2 * float(np.dot(w, w))

    best = loss(model.weights, model.thresholds)
    for k in range(5):  # no step in any direction lowers the loss
        for step in (-0.02, 0.02):
            w, cuts = model.weights.copy(), model.thresholds.copy()
            (w if k < 3 else cuts)[k % 3 if k < 3 else k - 3] += step
            assert loss(w, cuts) > best
    severity = model.scorer()([b"p r"])[0][0]
    z = model.weights[0] + model.weights[2]
    assert abs(severity - sum(1 / (1 + np.exp(-(z - c))) for c in model.thresholds)) < 1e-9


def test_toxicity_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "labels"))
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.where(even))
    r = toxicity.score(docs.select("doc_id", "text"), model).join(labels.where(~even), "doc_id").toPandas()
    assert (r.rejected == (r.toxic > 0)).mean() > 0.95
    assert r[r.toxic == 0].rejected.mean() < 0.01
    assert (np.diff(model.thresholds) > 0).all()
    odd = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert not any(x.rejected for x in toxicity.score(odd, model).collect())
    # repeated rows of labelled ids neither multiply the sample nor change the model
    small = docs.join(labels.where(even).select("doc_id"), "doc_id", "left_semi")
    again = toxicity.train(docs.union(small).union(small), labels.where(even))
    assert again.words == model.words and np.allclose(again.weights, model.weights)
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("rejected").count() == 0


def test_ordered_thresholds_share_weights():
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        at = [k for k in range(3) if draw.random() < 0.5]
        z = 3 * (0 in at) + 3 * (1 in at) - 2 * (2 in at) + draw.logistic()
        rows.append((int(z > 1) + int(z > 4), at))
    model = toxicity.fit(rows, [b"p", b"q", b"r"])
    assert model.weights[0] > 1.5 and model.weights[1] > 1.5 and model.weights[2] < -0.8
    severity, grade = model.scorer()([b"p q", b"p", b"r", None])
    assert severity[0] > severity[1] > severity[2] and grade[0] == 2 and grade[2] == 0


# -- URL lists -------------------------------------------------------------------------------------


def test_captures_against_dated_entries(spark):
    day = lambda k: date(2024, 1, k)
    events = [("bad.example", "add", day(3)), ("bad.example", "remove", day(6)), ("bad.example", "add", day(9)), ("site.example/p", "add", day(2)), ("twice.example", "add", day(1)), ("twice.example", "add", day(4)), ("gone.example", "add", day(5)), ("gone.example", "remove", day(5)), (None, "add", day(1)), ("x.example", None, day(1))]
    urls = ["http://bad.example/a", "https://u:p@Sub.bad.example:80/", "http://notbad.example/", "http://site.example/p/q", "http://site.example/px", "http://twice.example", "http://gone.example", "nonsense", None]
    rows = [(k * 100 + d, u, day(d), 1, 2) for k, u in enumerate(urls) for d in range(1, 12)] + [(1, urls[0], None, 1, 2), (101, urls[1], day(1), 1, 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, h int, Entry int")
    out = urlfilter.judge(frame, spark.createDataFrame(events, "pattern string, action string, at date")).collect()
    assert len(out) == len(rows)
    covers = {0: ["bad.example"], 1: ["bad.example"], 3: ["site.example/p"], 5: ["twice.example"]}
    active = {"bad.example": lambda d: 3 <= d < 6 or d >= 9, "site.example/p": lambda d: d >= 2, "twice.example": lambda d: True}
    for r in out:
        d = r.fetched_on and r.fetched_on.day
        want = [p for p in covers.get(urls.index(r.url), []) if d and active[p](d)]
        assert (r.blocked, r.n_entries, r.entry, r.h) == (bool(want), len(want), want[0] if want else None, 1), r
    assert urlfilter.judge(frame.limit(0), spark.createDataFrame([], "pattern string, action string, at date")).count() == 0


def test_single_labels_and_paths_with_case(spark):
    day = date(2024, 1, 5)
    events = [("zip", "add", day), ("Host.example/Ads", "add", day), ("", "add", day)]
    urls = ["http://a.b.zip/", "http://zip/", "http://HOST.example/Ads/1", "http://host.example/ads", "http://zip.example/", "http://end.example./"]
    frame = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    out = urlfilter.judge(frame, spark.createDataFrame(events, "pattern string, action string, at date")).orderBy("page_id").collect()
    assert [r.entry for r in out] == ["zip", "zip", "host.example/Ads", None, None, None]


def test_list_against_brute_force(spark):
    from urllib.parse import urlsplit

    draw = random.Random(13)
    labels, parts = ["a", "b", "c"], ["x", "y", "Z"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 4)))
    path = lambda: "".join(draw.choice(["/", "//"]) + draw.choice(parts) for _ in range(draw.randrange(0, 5)))
    events = [(host() + draw.choice(["", "/", path()]), draw.choice(["add", "add", "remove"]), date(2024, 1, draw.randrange(1, 20))) for _ in range(150)]
    rows = [(k, f"http://{host()}{path()}{draw.choice(['', '/', '?q=/x', '#/y'])}", date(2024, 1, draw.randrange(1, 25))) for k in range(400)]
    norm = lambda p: p.partition("/")[0].lower() + ("/" + "/".join(x for x in p.partition("/")[2].split("/") if x) if "/" in p else "")
    log = defaultdict(set)
    for p, what, at in events:
        log[norm(p)].add((at, what))
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, fetched_on date"), spark.createDataFrame(events, "pattern string, action string, at date")).collect()}
    for k, u, day in rows:
        name, segs = urlsplit(u).hostname, [x for x in urlsplit(u).path.split("/") if x]
        asked = {".".join(name.split(".")[i:]) for i in range(name.count(".") + 1)} | {f"{name}/" + "/".join(segs[:i]) for i in range(len(segs) + 1)}
        want = sorted(p for p in asked if (past := sorted(e for e in log[p] if e[0] <= day)) and past[-1][1] == "add")
        assert (out[k].n_entries, out[k].entry) == (len(want), want[0] if want else None), (u, day)


# -- registered queries ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
