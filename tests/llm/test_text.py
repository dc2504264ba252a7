import hashlib
import re
import textwrap
import time

import numpy as np
import public_tokenizers
import sentencepiece

from loomdex.llm import decontamination, license_scan, secrets
from loomdex.llm.sentencepiece_codec import Codec, Vocabulary, decode, encode
from loomdex.llm.token_counts import count_tokens

from .conftest import ODD, SF, WORDS, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts(docs, texts, odd, none):
    sp = library()
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, MODEL).collect()} == {i: len(sp.encode(t)) for i, t in texts.items()}
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, MODEL).collect()}
    assert found == {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in ODD}
    assert count_tokens(none, MODEL).count() == 0


def test_encoding_is_the_library_s(docs, texts, odd, none):
    sp = library()
    rows = encode(docs, MODEL).collect()
    assert all(r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in rows)
    found = {r.doc_id: r.ids for r in encode(odd, MODEL).collect()}
    assert found == {i: sp.encode(t or "") for i, t in ODD}
    assert encode(none, MODEL).count() == 0
    back = {r.doc_id: r.text for r in decode(encode(odd, MODEL), MODEL).collect()}
    assert back == {i: sp.decode(sp.encode(t or "")) for i, t in ODD}


def test_encoding_of_hard_texts():
    sp, codec = library(), Codec(Vocabulary(open(MODEL, "rb").read()))
    rng = np.random.default_rng(4)
    hard = ["", "  a  b\n\nc  d\t e ", "<s>a</s><0x0A>", " ", "\n", "\n a \n", "a▁b", "aaaaaaaaaaaaaaaaaaaaaaaab", "日本語\U0001f600x", "\0a\0", " \n  \n", "isn't 12345678"]
    hard += ["".join(chr(c) for c in rng.choice([32, 32, 10, 97, 98, 99, 101, 110, 111, 116, 233, 8364, 0x9FFF], 60)) for _ in range(200)]
    for text, ids in zip(hard, codec.encode_batch(hard)):
        assert np.frombuffer(ids, np.int32).tolist() == sp.encode(text), repr(text)
        assert codec.decode(np.array(sp.encode(text))) == sp.decode(sp.encode(text))


def test_encoding_of_long_runs_without_a_space():
    """As the library, and in time that grows with the length only."""
    sp, codec = library(), Codec(Vocabulary(open(MODEL, "rb").read()))
    rng = np.random.default_rng(8)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    lower_case, wide = "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
    runs = ["x" * 20_000, "ab" * 9_000, pick(lower_case, 20_000), pick(wide, 20_000), pick("0123456789abcdef", 20_000), pick("日本語の文字列", 5_000), "function(){return" * 2_000]
    for text in runs:
        assert np.frombuffer(codec.encode_batch([text])[0], np.int32).tolist() == sp.encode(text), text[:30]
    began = time.process_time()
    codec.encode_batch([pick(lower_case, 100_000)])
    assert time.process_time() - began < 10


def test_decoding_of_broken_bytes(spark):
    sp = library()
    ids = [sp.piece_to_id("<0xE2>"), sp.piece_to_id("<0x82>"), sp.piece_to_id("▁a"), 1, 2, 0]
    found = decode(spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>"), MODEL).collect()
    assert {r.doc_id: r.text for r in found} == {1: sp.decode(ids), 2: "", 3: ""}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_leaks(rows, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(len(w) - 7, min(1, len(w)))):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in rows:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def test_leaks(spark, docs, texts, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    found = {r[0]: tuple(r)[1:] for r in decontamination.summary(decontamination.find_leaks(docs, bench)).collect()}
    assert found == brute_leaks(texts.items(), items)
    more = [(1, " ".join(WORDS[10:30])), (2, "two words"), (3, None), (4, ""), (1, " ".join(WORDS[40:49])), (10, "again and again Hello"), (None, "a")]
    extra = spark.createDataFrame([(i, t, 1) for i, t in more], "item_id long, text string, n int")
    for size in (1 << 20, 200):  # one block, and several
        found = {r[0]: tuple(r)[1:] for r in decontamination.summary(decontamination.find_leaks(odd, extra, block_bytes=size)).collect()}
        assert found == brute_leaks(ODD, [x for x in more if x[0] is not None])
    assert decontamination.find_leaks(none, extra).count() == 0
    assert all(r.n_items == 0 for r in decontamination.summary(decontamination.find_leaks(odd, extra.limit(0))).collect())


def test_decontaminate(spark):
    passage, second = " ".join(WORDS[:12]), " ".join(WORDS[50:62])
    bench = spark.createDataFrame([("x", passage), ("y", second)], "item_id string, text string")
    rows = [(1, f"Before it. {passage}, behind it é."), (2, f"{passage} and {second}"), (3, "clean"), (4, None), (5, passage)]
    left = decontamination.decontaminate(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "Before it.  , behind it é.", 3: "clean", 4: None, 5: " "}


def test_secrets(spark, odd, none):
    token = "ghp_" + "a1B2c3D4e5" * 3 + "Z9y8X7"
    rows = [
        (1, 'api_key = "abcdefgh12" and PASSWORD: short'),
        (2, "x AKIAABCDEFGHIJKL12 é deadbeef" + "0" * 30),
        (3, f"the value of {token} was left in here"),
        (4, "token=abc token=abcdefgh AKIA12"),
    ]
    filler = [(100 + i, " ".join(WORDS[i : i + 60]) + ".\n" + " ".join(WORDS[i + 60 : i + 120])) for i in range(250)]
    found = {r.doc_id: r for r in secrets.summary(secrets.find_secrets(frame(spark, rows + filler))).collect()}
    assert [(found[i].n_assign, found[i].n_access, found[i].n_hex) for i in (1, 2, 3, 4)] == [(1, 0, 0), (0, 1, 1), (0, 0, 0), (1, 0, 0)]
    assert found[1].spans.startswith("assign:0:21")
    assert found[1].base_sha256 == hashlib.sha256(b"assign:0:21").hexdigest()
    assert found[2].base_sha256 == hashlib.sha256(b"access:2:20,hex:23:61").hexdigest()
    assert f"crf:13:{13 + len(token)}" in found[3].spans
    assert sum("crf" in found[100 + i].spans for i in range(250)) <= 5
    rows = {r.doc_id: r for r in secrets.summary(secrets.find_secrets(odd)).collect()}
    assert len(rows) == len(ODD) and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(none).count() == 0


def test_base_spans_are_those_of_a_plain_scan(texts):
    rules = ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), (r"AKIA[A-Z0-9]+", 0, 0, 16), (r"[0-9a-f]+", 0, 0, 32))
    hard = ["token=token=abcdefgh", "AKIAAKIA" + "A" * 12, "PassWord : 'x' secret='12345678", "f" * 31 + " " + "0" * 32 + "F", "api_key:=apikey: abcdefgh", "", "\u017fecret=abcdefgh \u212a", "é\U0001f600 token = a.b=c/d+e_"]
    for text in [*texts.values(), *hard]:
        found = []
        for kind, (pattern, flags, group, least) in enumerate(rules):
            rule, at = re.compile(pattern, flags), 0
            while at < len(text or ""):
                m = rule.match(text, at)
                if m and len(m[group]) >= least:
                    found.append((m.start(), kind, m.end()))
                at = m.end() if m else at + 1
        assert secrets.base_spans(text or "") == sorted(found)


def test_formats_that_were_not_trained_on(texts):
    """The field is fitted on random shapes; formats of vendors, none of which is written down there, are found."""
    plain = [(line, secrets.file_feature(t)) for t in texts.values() if t for line in t.split("\n") if len(line.split()) > 4 and not secrets.base_spans(line)]
    learn, held = plain[::2][:4_000], plain[1::2]
    scanner = secrets.Scanner(secrets.fit(secrets.training_lines(learn)))
    rng = np.random.default_rng(11)
    every = secrets.LOWER + secrets.UPPER + secrets.DIGIT
    pick = lambda n, letters=every: secrets.pick(rng, letters, n)
    formats = (lambda: "xoxb-" + pick(12, secrets.DIGIT) + "-" + pick(24), lambda: "AIza" + pick(35), lambda: "SG." + pick(22) + "." + pick(43), lambda: "hf_" + pick(34), lambda: "npm_" + pick(36), lambda: "ghp_" + pick(36))
    hit, wrong = 0, 0
    for i in range(300):
        words = held[int(rng.integers(0, len(held)))][0].split(" ")[:60]
        before, value = " ".join(words[:3]) + " ", formats[i % len(formats)]()
        spans = scanner.tagged([before + value + " " + " ".join(words[3:])])[0]
        hit += (len(before), len(before) + len(value)) in spans
        wrong += bool(scanner.tagged([" ".join([*words[:3], secrets.decoy(rng, words), *words[3:]])])[0])
    assert hit >= 270 and wrong <= 6


def test_lines_left_out_are_outside(texts):
    """Decoding every line gives the spans that decoding only the lines that can have a tag gives."""
    lines = [(line, secrets.file_feature(t)) for t in texts.values() for line in t.split("\n") if line]
    scanner = secrets.Scanner(secrets.fit(secrets.training_lines(lines[:1_500])))
    rng = np.random.default_rng(5)
    some = [secrets.secret_value(rng) + " " + line + " " + secrets.secret_value(rng) if i % 9 == 0 else line for i, (line, _) in enumerate(lines[:3_000])]
    few = scanner.tagged(some)
    scanner.can = lambda e, line: np.unique(line)
    assert scanner.tagged(some) == few and sum(map(len, few)) > 300


def test_token_scores_are_bounded(texts):
    tokens = secrets.Tokens(secrets.Field(np.zeros((1 << secrets.BITS, 3), np.float32), np.zeros((3, 3), np.float32), {}), most_chars=1_000)
    for i in range(5):
        tokens.of([f"{i}" * 900])
    assert len(tokens) <= 2


def test_training_lines_are_drawn_from_whole_texts(spark):
    text = "\n".join(f"line {i}" for i in range(2_000)) + "\n" + "word " * 5_000
    drawn = secrets.drawn_lines(frame(spark, [(i, text) for i in range(20)] + [(50, ""), (51, None)]))
    assert len(drawn) == 20 * secrets.TRAIN_LINES and all(len(x) <= secrets.TRAIN_CHARS for x, _ in drawn)
    assert max(int(x.split()[1]) for x, _ in drawn if x.startswith("line")) > 1_500


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(5)
    transitions = rng.normal(size=(3, 3)).astype(np.float32)
    transitions[0, 2] = secrets.NEVER
    e = rng.normal(size=(6, 5, 3)).astype(np.float32)
    sizes = np.array([5, 4, 3, 2, 1, 5])
    tags = secrets.viterbi(e, sizes, transitions)
    for i, n in enumerate(sizes):
        score = lambda p: sum(e[i, t, p[t]] for t in range(n)) + sum(transitions[a, b] for a, b in zip(p, p[1:])) + (secrets.NEVER if p[0] == 2 else 0)
        assert tuple(tags[i, :n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


def test_words_of_licenses_are_those_of_their_twin(docs, texts):
    hard = ["", "...", "a..", "..a.+b-", "+-a", "GPL-3.0-only. É x86_64 'MIT'", "-" * 5_000 + "a" + "." * 5_000 + "b", "\u0130K\u212a"]
    rows = docs.sparkSession.createDataFrame([(x,) for x in [*texts.values(), *hard]], "t string")
    assert all(r.w == license_scan.words_of(r.t) for r in rows.select("t", license_scan.words_column(rows.t).alias("w")).collect())


def test_licenses_of_wrapped_notices(spark, docs):
    """Each template of more than a line, wrapped at 72 columns behind comment marks, is one confirmed notice of its family."""
    model = license_scan.train(docs)
    notices = [(f, t) for f in ("agpl", "gpl", "lgpl", "bsd", "mit") for t in license_scan.TEMPLATES[f] if len(t) > 100]
    rows, truth = [], []
    for i, (family, t) in enumerate(notices):
        for k, mark in enumerate(("", "# ", " * ", "// ")):
            rows.append((10 * i + k, "\n".join(["import os", mark.rstrip(), *(mark + x for x in textwrap.wrap(t, 72 - len(mark))), mark.rstrip(), "code()"])))
            truth.append((10 * i + k, 2, family, True))
    found = license_scan.find_licenses(frame(spark, rows), model).collect()
    assert len(notices) == 5 and sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in found) == truth


def test_licenses(spark, docs, texts, odd, none):
    model = license_scan.train(docs)
    found = {(r.doc_id, r.paragraph): r for r in license_scan.find_licenses(docs, model).collect()}
    features = set(model.features)
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            p = model.probabilities([g for g in license_scan.grams(license_scan.words_of(line)) if g in features])
            best = max(p, key=p.get)
            assert ((i, k) in found) == (best != "none"), line
            if best != "none":
                assert found[i, k].family == (best if p[best] >= model.cut else "unknown")
                assert abs(found[i, k].probability - p[best]) < 1e-6
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Distributed under the Wobble License, version 7."]
    rows = license_scan.find_licenses(frame(spark, [(1, "\n".join(lines)), (2, None)]), model).orderBy("paragraph").collect()
    assert [r.family for r in rows] == ["mit", "apache", "cc-by-nc", "gpl", "unknown"]
    assert [r.confirmed for r in rows] == [True] * 4 + [False]
    assert license_scan.find_licenses(odd, model).where("family != 'unknown'").count() == 0
    assert license_scan.find_licenses(none, model).count() == 0
