"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token of a line as secret begin, inside or outside, from its shape, its neighbours and a feature
of the file. It is trained here, on lines of a bounded sample of documents into which secrets of public formats are
written by a seeded rule, and on the same lines without them. Feature weights sum to three scores per token text, so a
worker keeps them by token; a line in which no token can leave the outside tag (by an upper bound) is outside as a
whole, which is exactly what Viterbi would give, and the other lines are decoded by Viterbi, many at once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, lines_by_hash, map_arrow, sample_by_hash, strings

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails, and longer ones match as a whole
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/-]+|[^\w\s+/-]")
OUT, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e9
#: At most so many documents, lines of each, and characters and words of a line, give the training lines; lines and the
#: place in a long line are drawn by hash from the whole text.
TRAIN_DOCS, TRAIN_LINES, TRAIN_CHARS, TRAIN_TOKENS = 600, 12, 2_000, 40
EPOCHS, RATE, DECAY, BITS = 8, 0.5, 1e-4, 15
SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(token: str) -> str:
    """Kinds of characters in order, runs shortened to two."""
    out = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", token[:48])))
    out = re.sub(r"[^\x00-\x7F]", "u", out)
    return re.sub(r"(.)\1\1+", r"\1\1", out)


def form(token: str) -> tuple:
    """What the features of a token itself follow from. Words of letters share few forms."""
    if token.isalpha() and len(token) < 16:
        return len(token), token.islower(), token.isupper(), token.isascii()
    return (token,)


def token_features(token: str) -> tuple[list[str], list[str]]:
    """Features of a token itself, and those that its neighbours see of it besides the word."""
    n, low = len(token), token.lower()
    digits = sum(c.isdigit() for c in token)
    kinds = f"{not token.isupper():d}{not token.islower():d}{digits > 0:d}{any(c in '+/_-' for c in token):d}{not token.isascii():d}"
    size = n if n < 8 else 8 + min(n // 4, 12)
    own = ["bias", f"size={size}", f"kinds={kinds}", f"kinds,size={kinds},{size}"]
    if len(form(token)) == 1:
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
        hexes = n >= 8 and all(c in "0123456789abcdef" for c in low)
        kind = [c.isdigit() + 2 * c.isupper() for c in token]
        turns = min(12, sum(a != b for a, b in zip(kind, kind[1:], strict=False)))
        own += [f"turns={turns}", f"turns,size={turns // 2},{size}", f"changes={min(changes, 6)}", f"shape={shape(token)[:12]}", f"hex={hexes:d},{size}", f"head={token[:3] if n >= 16 else ''}"]
    if n == 1 and not token.isalnum():
        own.append(f"mark={token}")
    return own, [f"size={min(n, 20) // 4}", f"kinds={kinds}"]


def word_feature(token: str) -> str:
    return f"word={token[:20].lower()}"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Tokens(dict):
    """Scores by token text: nine numbers for each, of the token, as seen from the next one and from the one before."""

    def __init__(self, field: Field, most: int = 300_000, most_chars: int = 8_000_000):
        super().__init__()
        self.field, self.weights, self.most, self.forms = field, field.weights, most, {}
        self.chars, self.most_chars = 0, most_chars
        self.rows = np.zeros((4096, 9), np.float32)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        key = form(token)
        row = self.forms.get(key)
        if row is None:
            own, seen = token_features(token)
            row = np.concatenate([self.weights[[bucket(f"{at}:{f}") for f in fs]].sum(axis=0) for at, fs in (("own", own), ("previous", seen), ("next", seen))])
            if len(self.forms) < self.most:
                self.forms[key] = row
        word = self.field.words.get(token[:20].lower())
        self.rows[n] = row if word is None else row + np.concatenate([np.zeros(3, np.float32), *word])
        self[token] = n
        self.chars += len(token)
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.most or self.chars > self.most_chars:
            self.clear()
            self.forms.clear()
            self.chars = 0
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.rows[at]


def emissions(rows: np.ndarray, lines: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Scores of the three tags for each token: its own, its neighbours' within the line, and the file's."""
    e = rows[:, :3] + file
    same = lines[1:] == lines[:-1]
    e[1:] += rows[:-1, 3:6] * same[:, None]
    e[:-1] += rows[1:, 6:9] * same[:, None]
    return e


def viterbi(e: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best tags of many lines; e: (line, position, tag), padded."""
    n, most, _ = e.shape
    score = e[:, 0].copy()
    score[:, INSIDE] = NEVER
    back = np.zeros((n, most, 3), np.int8)
    for t in range(1, most):
        options = score[:, :, None] + transitions[None]
        back[:, t] = options.argmax(axis=1)
        score = np.where((t < sizes)[:, None], options.max(axis=1) + e[:, t], score)
    tags = np.zeros((n, most), np.int8)
    now = score.argmax(axis=1)
    for t in reversed(range(most)):
        live = t < sizes
        tags[live, t] = now[live]
        if t:
            now = np.where(live, back[np.arange(n), t, now], now)
    return tags


@dataclass
class Field:
    """Weights by feature bucket and tag, transitions from tag to tag, and scores of words seen in training."""

    weights: np.ndarray
    transitions: np.ndarray
    #: Scores of a known word for the next token and for the one before.
    words: dict[str, tuple[np.ndarray, np.ndarray]]

    def file(self, text: str) -> np.ndarray:
        return self.weights[bucket(f"file={file_feature(text)}")]


def file_feature(text: str) -> int:
    return min(3, int(200 * sum(text.count(c) for c in "={};") / max(1, len(text))))


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (DIGIT + "abcdef", DIGIT + "ABCDEF", LOWER + DIGIT, UPPER + DIGIT, LOWER + UPPER + DIGIT, LOWER + UPPER + DIGIT, LOWER + UPPER + DIGIT + "+/", LOWER + UPPER + DIGIT + "_-")


def pick(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def secret_value(rng: np.random.Generator) -> str:
    """A made-up secret: random characters of a random alphabet and length, in one to three parts, often behind a random prefix.

    No vendor's format is written down, so the field cannot learn formats by heart.
    """
    letters = ALPHABETS[rng.integers(0, len(ALPHABETS))]
    parts = int(rng.choice([1, 1, 1, 2, 3]))
    body = str(rng.choice([".", "-"])).join(pick(rng, letters, int(rng.integers(16, 49) if parts == 1 else rng.integers(10, 33))) for _ in range(parts))
    at = int(rng.integers(1, 8))  # always some digit among the first ones
    body = body[:at] + pick(rng, DIGIT, 2) + body[at:]
    if rng.random() < 0.5:
        return body
    head = pick(rng, (LOWER, UPPER, LOWER + UPPER)[rng.integers(0, 3)], int(rng.integers(2, 6)))
    middle = pick(rng, LOWER, int(rng.integers(2, 5))) + str(rng.choice(["_", "-"])) if rng.random() < 0.3 else ""
    return head + str(rng.choice(["_", "-", "", "."])) + middle + body


def decoy(rng: np.random.Generator, words: list[str]) -> str:
    """What may look like a secret and is none: identifiers made of words, numbers, dates, versions, paths."""
    own = [w for w in words if w.isalpha()] or ["name"]
    some = [str(own[i]) for i in rng.integers(0, len(own), int(rng.integers(2, 6)))]
    kind = rng.integers(0, 7)
    if kind == 0:
        return "_".join(some) + pick(rng, DIGIT, int(rng.integers(0, 3)))
    if kind == 1:
        return "".join(w[:1].upper() + w[1:] for w in some) + pick(rng, DIGIT, int(rng.integers(0, 3)))
    if kind == 2:
        return pick(rng, DIGIT, int(rng.integers(4, 25)))
    if kind == 3:
        return "20" + pick(rng, DIGIT, 2) + "-0" + pick(rng, "123456789", 1) + "-1" + pick(rng, DIGIT, 1)
    if kind == 4:
        return "v" + ".".join(pick(rng, DIGIT, int(rng.integers(1, 3))) for _ in range(3))
    if kind == 5:
        return "-".join(some) + "-" + pick(rng, DIGIT, int(rng.integers(1, 5)))
    return "https://example.com/" + "/".join(some) + "/" + pick(rng, DIGIT, int(rng.integers(1, 7)))


def unclear(line: str, secrets: list[tuple[int, int]]) -> bool:
    """Whether a long mixed token that no pattern finds stands in the line: it may be a secret, so it teaches nothing."""
    for m in TOKEN.finditer(line):
        mixed = len(m[0]) >= 20 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        if mixed and not any(s <= m.start() < e for s, e in secrets):
            return True
    return False


def training_lines(drawn: list[tuple[str, int]], seed: int = 3) -> list[tuple[list[str], list[int], int]]:
    """(tokens, tags, file feature) of lines (text, file feature) as they are, tagged by the fixed patterns, and with a
    secret or a decoy written in."""
    rng = np.random.default_rng(seed)
    out = []
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "Authorization")
    for line, file in drawn:
        line = " ".join(line.split(" ")[:TRAIN_TOKENS])
        secrets = [(s, e) for s, k, e in base_spans(line)]
        secrets = [(ASSIGN.match(line, s).start(2) if ASSIGN.match(line, s) else s, e) for s, e in secrets]
        hidden = unclear(line, secrets)
        if not hidden:
            out.append((line, secrets, file))
        chance = rng.random()
        if secrets or hidden or chance < 0.2:
            continue
        words_ = line.split(" ")
        at, real = int(rng.integers(0, len(words_) + 1)), chance < 0.7
        value = secret_value(rng) if real else decoy(rng, words_)
        key = str(rng.choice(keys if real else ("id", "name", "page", "date", "version", "see", "commit", "key")))
        lead = str(rng.choice(["", f"{key} = ", f"{key}: ", f"{key}=", f'{key} = "', f"{key} "]))
        before = "".join(x + " " for x in words_[:at]) + lead
        out.append((before + value + ('"' if lead.endswith('"') else "") + "".join(" " + x for x in words_[at:]), [(len(before), len(before) + len(value))] if real else [], file))
    tagged = []
    for line, secrets, file in out:
        tokens, tags = [], []
        for m in TOKEN.finditer(line):
            if len(tokens) == 2 * TRAIN_TOKENS:
                break
            tokens.append(m[0])
            hit = next(((s, e) for s, e in secrets if s <= m.start() < e), None)
            tags.append(OUT if hit is None else BEGIN if m.start() == hit[0] or not tags or tags[-1] == OUT else INSIDE)
        if tokens:
            tagged.append((tokens, tags, file))
    return tagged


def fit(lines: list[tuple[list[str], list[int], int]], seed: int = 4) -> Field:
    """Gradient ascent on the log-likelihood (AdaGrad); marginals by forward and backward sums over many lines at once."""
    rng = np.random.default_rng(seed)
    weights, transitions = np.zeros((1 << BITS, 3), np.float64), np.zeros((3, 3))
    transitions[OUT, INSIDE] = NEVER
    gw, gt = np.full_like(weights, 1e-6), np.full((3, 3), 1e-6)
    known: dict[str, tuple[list[int], list[int], list[int]]] = {}
    ids = []
    for tokens, _, file in lines:
        rows = []
        for x in tokens:
            if x not in known:
                own, seen = token_features(x)
                seen = [*seen, word_feature(x)]
                known[x] = tuple([bucket(f"{at}:{f}") for f in fs] for at, fs in (("own", own), ("previous", seen), ("next", seen)))
        for i, x in enumerate(tokens):
            rows.append(known[x][0] + (known[tokens[i - 1]][1] if i else []) + (known[tokens[i + 1]][2] if i + 1 < len(tokens) else []) + [bucket(f"file={file}")])
        ids.append(rows)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    by_size = sorted(range(len(lines)), key=lambda i: len(lines[i][0]))
    batches = [by_size[i : i + 64] for i in range(0, len(by_size), 64)]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            own = batches[b]
            sizes = np.array([len(lines[i][0]) for i in own])
            flat = [r for i in own for r in ids[i]]
            count = np.array([len(r) for r in flat])
            feature = np.concatenate(flat)
            token = np.repeat(np.arange(len(flat)), count)
            e_flat = np.zeros((len(flat), 3))
            for k in range(3):
                e_flat[:, k] = np.bincount(token, weights[feature, k], len(flat))
            line = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            most = int(sizes.max())
            e, gold = np.zeros((len(own), most, 3)), np.zeros((len(own), most), int)
            e[line, place] = e_flat
            gold[line, place] = np.concatenate([lines[i][1] for i in own])
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0] + [0, 0, NEVER]
            for t in range(1, most):
                forward[:, t] = np.where((t < sizes)[:, None], lse(forward[:, t - 1, :, None] + transitions[None], 1) + e[:, t], forward[:, t - 1])
            total = lse(forward[:, -1], 1)
            for t in reversed(range(most - 1)):
                backward[:, t] = np.where((t + 1 < sizes)[:, None], lse(transitions[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
            marginal = np.exp(np.minimum(0, forward + backward - total[:, None, None]))
            right = np.eye(3)[gold] - marginal
            g_flat = right[line, place]
            grad_t = np.zeros((3, 3))
            for t in range(1, most):
                live = t < sizes
                pair = np.exp(np.minimum(0, forward[:, t - 1, :, None] + transitions[None] + (e[:, t] + backward[:, t])[:, None, :] - total[:, None, None]))[live]
                grad_t -= pair.sum(axis=0)
                np.add.at(grad_t, (gold[live, t - 1], gold[live, t]), 1)
            at = np.unique(feature)
            g = np.stack([np.bincount(feature, g_flat[token, k], 1 << BITS)[at] for k in range(3)], 1) / len(own) - DECAY * weights[at]
            gw[at] += g * g
            weights[at] += RATE * g / np.sqrt(gw[at])
            grad_t /= len(own)
            gt += grad_t**2
            transitions += RATE * grad_t / np.sqrt(gt)
            transitions[OUT, INSIDE] = NEVER
    weights = weights.astype(np.float32)
    seen_words = {x[:20].lower() for x in known}
    return Field(weights, transitions.astype(np.float32), {x: tuple(weights[bucket(f"{at}:word={x}")] for at in ("previous", "next")) for x in seen_words})


class Scanner:
    """Decodes texts with a field; keeps token scores between calls."""

    def __init__(self, field: Field):
        self.field, self.tokens = field, Tokens(field)
        # What the transitions into a token can add at most to tagging it begin or inside instead of outside. The way back
        # to outside is counted with the begin that each secret has; into the first token of a line there is no transition.
        t = field.transitions - field.transitions[OUT, OUT]
        back = max(0.0, float(t[[BEGIN, INSIDE], OUT].max()))
        self.first, self.begin, self.inside = back, back + float(t[:, BEGIN].max()), float(t[[BEGIN, INSIDE], INSIDE].max())

    def can(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Lines that may have a tagged token: where every token loses by any tag, all of them are outside."""
        begin = np.full(len(e), self.begin, np.float32)
        begin[np.flatnonzero(np.r_[True, line[1:] != line[:-1]])] = self.first
        return np.unique(line[np.maximum(e[:, BEGIN] + begin, e[:, INSIDE] + self.inside) > e[:, OUT] - 1e-4])

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of secrets in each text."""
        lines, owner, leads = [], [], []
        for i, text in enumerate(texts):
            at = 0
            for own in text.split("\n"):
                lines.append(own)
                owner.append(i)
                leads.append(at)
                at += len(own) + 1
        found = [TOKEN.findall(x) for x in lines]
        sizes = np.array([len(x) for x in found], np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not sizes.sum():
            return spans
        line = np.repeat(np.arange(len(lines)), sizes)
        files = np.stack([self.field.file(x) for x in texts])
        e = emissions(self.tokens.of([x for f in found for x in f]), line, files[np.array(owner)[line]])
        start = np.cumsum(sizes) - sizes
        for own in self.batches(self.can(e, line), sizes):
            n = sizes[own]
            padded = np.zeros((len(own), int(n.max()), 3), np.float32)
            which = np.repeat(np.arange(len(own)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            padded[which, place] = e[start[own][which] + place]
            tags = viterbi(padded, n, self.field.transitions)
            for k in np.flatnonzero(tags.any(axis=1)):
                number = own[k]
                lead = leads[number]
                now = None
                for tag, m in zip(tags[k], TOKEN.finditer(lines[number]), strict=False):
                    if now is not None and tag != INSIDE:
                        spans[owner[number]].append(now)
                        now = None
                    if tag == BEGIN:
                        now = (lead + m.start(), lead + m.end())
                    elif tag == INSIDE and now is not None:
                        now = (now[0], lead + m.end())
                if now is not None:
                    spans[owner[number]].append(now)
        return [sorted(x) for x in spans]

    @staticmethod
    def batches(lines: np.ndarray, sizes: np.ndarray, cells: int = 400_000):
        """Lines of like length together, of a bounded number of padded tokens; a line beyond that is by itself."""
        lines = lines[np.argsort(sizes[lines], kind="stable")]
        at = 0
        while at < len(lines):
            room = np.arange(1, len(lines) - at + 1) * sizes[lines[at:]] <= cells
            n = max(1, int(np.argmin(room)) if not room.all() else len(room))
            yield lines[at : at + n]
            at += n


def drawn_lines(docs: DataFrame) -> list[tuple[str, int]]:
    """(text, file feature) of lines drawn by hash from each document (doc_id, text)."""
    text = F.col("text")
    share = (F.length(text) - F.length(F.translate(text, "={};", ""))) * 200 / F.greatest(F.length(text), F.lit(1))
    lines = F.explode(lines_by_hash(F.col("doc_id"), text, TRAIN_LINES, TRAIN_CHARS))
    rows = docs.where("text is not null").select("doc_id", F.least(F.floor(share), F.lit(3)).cast("int").alias("file"), lines.alias("s")).select("doc_id", "s.h", "s.x", "file")
    return [(r.x, r.file) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.doc_id, r.h, r.x))]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, base and spans (kind, start, end in code points; by start, then kind as in KINDS).

    base: the fixed patterns' spans, those of a kind without overlap. spans: these, and those the field adds, which
    overlap none of them. Null and empty texts have none. Rows that repeat are scanned each; null ids stay null. An
    empty table has no training lines, and the field then adds nothing. Extra columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = sample_by_hash(source.select("doc_id").where("doc_id is not null"), "doc_id", train_docs)
    lines = training_lines(drawn_lines(source.join(F.broadcast(drawn.distinct()), "doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(lines) if lines else None)

    def run(batches: Batches) -> Batches:
        scanner = Scanner(shared.value) if shared.value else None
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        structs = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in xs]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = strings(part.column(1))
                base, every = [base_spans(x) for x in texts], []
                for own, more in zip(base, scanner.tagged(texts) if scanner else [[]] * len(texts), strict=True):
                    more = [(s, 3, e) for s, e in more if not any(s < e2 and s2 < e for s2, _, e2 in own)]
                    every.append(sorted(own + more))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(structs, base), kind), pa.array(map(structs, every), kind)], ["doc_id", "base", "spans"])

    return map_arrow(source, run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of find_secrets()'s rows."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
