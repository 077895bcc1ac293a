"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import inspect
import io
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.llm import seeds
from skeinlab.llm.words import folded
from skeinlab.runtime import clean_id, own_id, shared_dir

#: Labelled rows, and unlabelled texts of the corpus, that the model is fitted on at most: the smallest sample_ids, and the
#: texts with the smallest hashes.
LABELS, BACKGROUND = 20_000, 6_000
#: Tokens of a window, and from one window to the next; every token is in one or two windows, every run of up to 9 in one.
WINDOW, STRIDE = 24, 16
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 8192, 8192, 16, 16
THRESHOLD = 0.8
MEMBERS, EPOCHS, BATCH = 2, 18, 64
#: In an epoch: crops of each longer harmless text, and of unlabelled texts.
CROPS, BACKGROUND_CROPS = 4, 2_500
#: Share of a short text's words left out where it is set into other surroundings; of words misspelled; of words whose own row is hidden.
DROPPED, NOISE, WORDS_UNKNOWN = 0.1, 0.06, 0.2
#: Loss from which a label, or an unlabelled text taken as harmless, is not believed.
LABEL_TRIM, GUESS_TRIM = 2.5, 2.5
#: Share of the unlabelled texts that an ordinary word is in, and words on either side of a rarer one that are left out with it.
RARE, AROUND_RARE = 0.005, 6
DECAY = 2e-3
#: Texts and windows scored at once, and words kept by a worker.
TEXTS_AT_ONCE, WINDOWS_AT_ONCE, WORDS_KEPT = 4_000, 512, 100_000

# Letters of other scripts, and digits and signs, that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss",
}
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LOOK = str.maketrans(LOOKALIKES)
_DIGITS = str.maketrans(DIGIT_LETTERS)
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*@$#'’](?=[^\W_*@$#]|[*@$#]+[^\W_]))*|[!?]+")
_REPEAT = re.compile(r"(.)\1+")


def tokens(text: str | None) -> list[str]:
    """Words without case, accents, invisible characters and foreign lookalikes; signs inside words stay."""
    if not text:
        return []
    s = folded(text)
    if not s.isascii():
        s = s.translate(_LOOK)
    return _TOKEN.findall(s)


def skeleton(word: str) -> str:
    """A word with digits and signs read as letters and repeated letters once; numbers are one word."""
    if word.isdigit():
        return "0"
    if word[0] in "!?":
        return "!"
    return _REPEAT.sub(r"\1", word.translate(_DIGITS).replace("'", "").replace("’", ""))


def _row(s: str, rows: int, seed: int) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass"), seed) % rows


def features(word: str) -> tuple[int, list[int]]:
    """Row of the word and rows of its character trigrams."""
    s = skeleton(word)
    t = f"^{s}$"
    return _row(s, WORD_ROWS, 1), [_row(t[i : i + 3], CHAR_ROWS, 2) for i in range(max(1, len(t) - 2))]


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over all n tokens."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    begins = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(b, b + WINDOW) for b in begins]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Committee:
    """Networks that all score every window; a window's score is the mean of theirs, a text's the highest of its windows."""

    def __init__(self, members: list[dict[str, np.ndarray]]):
        self.members = members
        self._both = np.stack([m[k] for m in members for k in ("fu", "bu")])
        self._out = {k: np.stack([m[k] for m in members]) for k in ("aw", "av", "ow", "ob", "ov", "oc")}
        self._known: dict[str, int] = {}
        self._rows, self._n = np.zeros((1024, 2 * len(members), 3 * HIDDEN), dtype=np.float32), 1

    def _inputs(self, word: str) -> np.ndarray:
        w, c = features(word)
        rows = []
        for m in self.members:
            x = np.concatenate([m["word"][w], m["char"][c].mean(axis=0)])
            rows += [x @ m["fx"] + m["fb"], x @ m["bx"] + m["bb"]]
        return np.stack(rows)

    def index(self, words: list[str]) -> list[int]:
        """Rows of words in the table of ready gate inputs of all members and directions; row 0 is padding."""
        if self._n > WORDS_KEPT:
            self._known, self._n = {}, 1
        out = []
        for w in words:
            i = self._known.get(w)
            if i is None:
                i = self._n
                if i >= len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
                self._rows[i] = self._inputs(w)
                self._known[w] = i
                self._n = i + 1
            out.append(i)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; 0 without a token."""
        out = np.zeros(len(texts), dtype=np.float32)
        for begin in range(0, len(texts), TEXTS_AT_ONCE):
            if self._n > WORDS_KEPT:
                self._known, self._n = {}, 1
            rows, of = [], []
            for k, text in enumerate(texts[begin : begin + TEXTS_AT_ONCE], begin):
                found = self.index(tokens(text))
                for a, b in windows(len(found)):
                    rows.append(found[a:b])
                    of.append(k)
            np.maximum.at(out, np.array(of, dtype=np.int64), self.score_rows(rows))
        return out

    def score_rows(self, rows: list[list[int]]) -> np.ndarray:
        """Score of each window, given by rows of the table."""
        sizes, out = np.array([len(r) for r in rows], dtype=np.int64), np.zeros(len(rows), dtype=np.float32)
        order = np.argsort(sizes, kind="stable")
        for begin in range(0, len(order), WINDOWS_AT_ONCE):
            at = order[begin : begin + WINDOWS_AT_ONCE]
            idx = np.zeros((len(at), int(sizes[at[-1]])), dtype=np.int64)
            for r, i in enumerate(at):
                idx[r, : sizes[i]] = rows[i]
            out[at] = self._probabilities(idx, sizes[at])
        return out

    def _probabilities(self, idx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h, m = HIDDEN, len(self.members)
        b, n = idx.shape
        states = np.empty((m, n, b, 2 * h), dtype=np.float32)
        state = np.zeros((2 * m, b, h), dtype=np.float32)
        ragged = sizes[0] < n
        for t in range(n):
            g = np.empty((2 * m, b, 3 * h), dtype=np.float32)
            g[0::2] = self._rows[idx[:, t], 0::2].transpose(1, 0, 2)
            g[1::2] = self._rows[idx[:, n - 1 - t], 1::2].transpose(1, 0, 2)
            r = np.matmul(state, self._both)
            gates = g[:, :, : 2 * h]
            gates += r[:, :, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = r[:, :, 2 * h :]
            new *= gates[:, :, :h]
            new += g[:, :, 2 * h :]
            np.tanh(new, out=new)
            step = state - new
            step *= gates[:, :, h:]
            step += new
            if ragged:  # padding leaves a state as it is
                step[0::2] = np.where((t < sizes)[:, None], step[0::2], state[0::2])
                step[1::2] = np.where((n - 1 - t < sizes)[:, None], step[1::2], state[1::2])
            state = step
            states[:, t, :, :h] = state[0::2]
            states[:, n - 1 - t, :, h:] = state[1::2]
        energy = np.tanh(np.matmul(states.reshape(m, n * b, 2 * h), self._out["aw"]))
        energy = np.matmul(energy, self._out["av"][:, :, None]).reshape(m, n, b)
        energy[:, np.arange(n)[:, None] >= sizes[None]] = -1e9
        weight = np.exp(energy - energy.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("mnb,mnbh->mbh", weight, states)
        top = np.tanh(np.matmul(pooled, self._out["ow"]) + self._out["ob"][:, None])
        logits = np.matmul(top, self._out["ov"][:, :, None])[:, :, 0] + self._out["oc"]
        return _sigmoid(logits).mean(axis=0)


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def w(*shape, scale=None):
        return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

    h, d = HIDDEN, 2 * WIDTH
    zero = lambda n: np.zeros(n, dtype=np.float32)
    return {
        "word": w(WORD_ROWS, WIDTH, scale=0.03), "char": w(CHAR_ROWS, WIDTH, scale=0.05), "fx": w(d, 3 * h), "fb": zero(3 * h), "bx": w(d, 3 * h), "bb": zero(3 * h),
        "fu": w(h, 3 * h), "bu": w(h, 3 * h), "aw": w(2 * h, h), "av": w(h), "ow": w(2 * h, h), "ob": zero(h), "ov": w(h), "oc": zero(1),
    }


def _gradients(p, word, chars, char_of, n_chars, mask, y, weight):
    """Loss and gradients of a batch by backpropagation through time. word: steps x batch rows; chars: flat trigram rows
    with the (step, batch) place char_of of each; mask: steps x batch."""
    h = HIDDEN
    n, b = word.shape
    char = np.zeros((n * b, WIDTH), dtype=np.float32)
    np.add.at(char, char_of, p["char"][chars])
    x = np.concatenate([p["word"][word], (char / n_chars[:, None]).reshape(n, b, WIDTH)], axis=2)
    kept, states = {}, np.zeros((n, b, 2 * h), dtype=np.float32)
    for s, (d, steps) in enumerate((("f", range(n)), ("b", range(n - 1, -1, -1)))):
        gx = x @ p[d + "x"] + p[d + "b"]
        state, trace = np.zeros((b, h), dtype=np.float32), []
        for t in steps:
            r = state @ p[d + "u"]
            gates = _sigmoid(gx[t, :, : 2 * h] + r[:, : 2 * h])
            new = np.tanh(gx[t, :, 2 * h :] + gates[:, :h] * r[:, 2 * h :])
            m = mask[t][:, None]
            trace.append((t, state, r[:, 2 * h :], gates, new))
            state = m * (gates[:, h:] * state + (1 - gates[:, h:]) * new) + (1 - m) * state
            states[t, :, h * s : h * s + h] = state
        kept[d] = trace
    ta = np.tanh(states @ p["aw"])
    energy = np.where(mask > 0, ta @ p["av"], -1e9)
    att = np.exp(energy - energy.max(axis=0))
    att /= att.sum(axis=0)
    pooled = np.einsum("nb,nbh->bh", att, states)
    to = np.tanh(pooled @ p["ow"] + p["ob"])
    logit = to @ p["ov"] + p["oc"][0]
    prob = _sigmoid(logit)
    each = np.logaddexp(0, logit) - y * logit
    g = {}
    dlogit = (prob - y) * weight / max(1.0, weight.sum())
    g["oc"], g["ov"] = np.array([dlogit.sum()], dtype=np.float32), to.T @ dlogit
    dto = dlogit[:, None] * p["ov"] * (1 - to**2)
    g["ow"], g["ob"] = pooled.T @ dto, dto.sum(axis=0)
    dpool = dto @ p["ow"].T
    datt = np.einsum("bh,nbh->nb", dpool, states)
    denergy = att * (datt - (att * datt).sum(axis=0))
    dta = denergy[:, :, None] * p["av"] * (1 - ta**2)
    g["av"] = np.einsum("nb,nbh->h", denergy, ta)
    g["aw"] = states.reshape(-1, 2 * h).T @ dta.reshape(-1, h)
    dstates = att[:, :, None] * dpool[None] + dta @ p["aw"].T
    dx = np.zeros_like(x)
    for s, d in enumerate("fb"):
        du, dgx = np.zeros_like(p[d + "u"]), np.zeros((n, b, 3 * h), dtype=np.float32)
        back = np.zeros((b, h), dtype=np.float32)
        for t, state, rn, gates, new in reversed(kept[d]):
            m = mask[t][:, None]
            total = back + dstates[t, :, h * s : h * s + h]
            dn = m * total
            r, z = gates[:, :h], gates[:, h:]
            dnew = dn * (1 - z) * (1 - new**2)
            dz = dn * (state - new) * z * (1 - z)
            dr = dnew * rn * r * (1 - r)
            dgx[t] = np.concatenate([dr, dz, dnew], axis=1)
            dr3 = np.concatenate([dr, dz, dnew * r], axis=1)
            du += state.T @ dr3
            back = (1 - m) * total + dn * z + dr3 @ p[d + "u"].T
        g[d + "u"] = du
        g[d + "x"] = x.reshape(-1, 2 * WIDTH).T @ dgx.reshape(-1, 3 * h)
        g[d + "b"] = dgx.sum(axis=(0, 1))
        dx += dgx @ p[d + "x"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], word.reshape(-1), dx[:, :, :WIDTH].reshape(-1, WIDTH))
    dchar = dx[:, :, WIDTH:].reshape(n * b, WIDTH) / n_chars[:, None]
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], chars, dchar[char_of])
    return each, g


def _noisy(word: str, rng: np.random.Generator) -> str:
    """A word as someone evading a filter, or a bad typist, might write it."""
    if len(word) < 4 or not word.isalpha():
        return word
    i = int(rng.integers(1, len(word) - 1))
    turn = rng.integers(4)
    if turn == 0:
        return word[:i] + "*" + word[i + 1 :]
    if turn == 1:
        return word[:i] + "".join(c for c in word[i:] if c not in "aeiou")
    return word[:i] + word[i] + word[i:] if turn == 2 else word[:i] + word[i + 1 :]


@dataclass
class Pools:
    """What a fit draws its windows from: labelled texts of one window, windows of longer abusive texts, and harmless
    words around them (longer harmless texts, and unlabelled ones). nouns are ordinary words of the corpus."""

    short: list[tuple[list[str], int]]
    long_abusive: list[list[list[str]]]
    harmless: list[list[str]]
    background: list[list[str]]
    nouns: list[str]

    def windows(self, rng: np.random.Generator, best: list[list[str]]) -> list[tuple[list[str], int, bool]]:
        """One epoch: windows, their label, and whether the label is only supposed."""
        around_all = self.background + self.harmless or [["it", "is", "fine"] * WINDOW]

        def crop(words, size):
            a = int(rng.integers(0, max(1, len(words) - size + 1)))
            return words[a : a + size]

        def within(words):
            words = [w for w in words if rng.random() >= DROPPED] or words
            words = words[:WINDOW]
            around = crop(around_all[int(rng.integers(len(around_all)))], int(rng.integers(0, WINDOW - len(words) + 1)))
            at = int(rng.integers(0, len(around) + 1))
            return around[:at] + words + around[at:]

        out = [(w, y, False) for w, y in self.short]
        out += [(within(w), y, False) for w, y in self.short if 2 <= len(w) <= 18]
        for label, of in ((1, seeds.ABUSE), (0, seeds.HARMLESS)):
            for s in seeds.sentences(of):
                out += [(f(tokens(seeds.filled(s, rng, () if label else self.nouns))[:WINDOW]), label, False) for f in (list, within)]
        out += [(w, 1, False) for w in best]
        out += [(crop(w, WINDOW), 0, False) for w in self.harmless for _ in range(CROPS)]
        out += [(crop(w, int(rng.integers(1, WINDOW + 1))), 0, True) for w in (self.background[i] for i in rng.permutation(len(self.background))[:BACKGROUND_CROPS])]
        return [([_noisy(w, rng) if rng.random() < NOISE else w for w in ws], y, guess) for ws, y, guess in out]


def _fit(pools: Pools, seed: int, epochs: int) -> dict:
    """Adam over windows drawn anew in every epoch. After a third of the epochs, labels that the rest speaks strongly
    against don't count, nor does unlabelled text that looks abusive; and of each longer abusive text the window that
    looks most abusive is its example."""
    rng = np.random.default_rng(seed)
    p = _fresh(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    memo: dict[str, tuple[int, list[int]]] = {}
    unknown = _row("?", WORD_ROWS, 1)
    step = 0
    for epoch in range(epochs):
        late = epoch >= epochs // 3
        best = []
        if late and pools.long_abusive:
            judge = Committee([p])
            best = [w[int(np.argmax(judge.score_rows([judge.index(x) for x in w])))] for w in pools.long_abusive]
        sample = pools.windows(rng, best)
        order = rng.permutation(len(sample))
        order = order[np.argsort(np.array([len(sample[i][0]) // 6 for i in order]), kind="stable")]
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rate = 0.006 * (1 - epoch / epochs) + 0.0003
        for k in rng.permutation(len(batches)):
            part = [sample[i] for i in batches[k]]
            n = max(len(w) for w, _, _ in part)
            word = np.zeros((n, len(part)), dtype=np.int64)
            mask = np.zeros((n, len(part)), dtype=np.float32)
            drop = rng.random((n, len(part))) < WORDS_UNKNOWN
            chars, char_of, n_chars = [], [], np.ones(n * len(part), dtype=np.float32)
            for b, (ws, _, _) in enumerate(part):
                for t, w in enumerate(ws):
                    f = memo.get(w)
                    if f is None:
                        f = memo[w] = features(w)
                    word[t, b] = unknown if drop[t, b] else f[0]
                    mask[t, b] = 1
                    chars.extend(f[1])
                    char_of.extend([t * len(part) + b] * len(f[1]))
                    n_chars[t * len(part) + b] = len(f[1])
            y = np.array([y for _, y, _ in part], dtype=np.float32)
            guess = np.array([g for _, _, g in part])
            soft = y * 0.96 + 0.02
            weight = np.ones(len(part), dtype=np.float32)
            at = (np.array(chars), np.array(char_of), n_chars, mask, soft)
            each, g = _gradients(p, word, *at, weight)
            if late:
                weight = (each < np.where(guess, GUESS_TRIM, LABEL_TRIM)).astype(np.float32)
                if not weight.all():
                    each, g = _gradients(p, word, *at, weight)
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                m, s = moments[name]
                m += 0.1 * (v - m)
                s += 0.01 * (v**2 - s)
                p[name] -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7) + (DECAY * p[name] if p[name].ndim == 2 else 0))
    return p


def ordinary(background: list[list[str]]) -> list[list[str]]:
    """Runs of words of unlabelled texts away from rare words: what isn't ordinary in the corpus may be abuse, and must
    not be learned as harmless."""
    seen = Counter(w for words in background for w in set(words))
    least = max(2, RARE * len(background))
    out = []
    for words in background:
        near = np.zeros(len(words), dtype=bool)
        for i, w in enumerate(words):
            if seen[w] < least and not w.isdigit():
                near[max(0, i - AROUND_RARE) : i + AROUND_RARE + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[1], near, [1]])))
        out += [words[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return out


def pools_of(texts: list[str], labels: list[int], background: list[str]) -> Pools:
    split = [(w, int(y)) for t, y in zip(texts, labels) if (w := tokens(t))]
    long = [(w, y) for w, y in split if len(w) > WINDOW]
    common = ordinary([w for t in background if (w := tokens(t))])
    return Pools(
        [(w, y) for w, y in split if len(w) <= WINDOW], [[w[a:b] for a, b in windows(len(w))] for w, y in long if y],
        [w for w, y in long if not y], common, sorted({w for words in common for w in words if w.isalpha()}),
    )


def train(texts: list[str], labels: list[int], background: list[str] | None = None, seed: int = 7, epochs: int = EPOCHS, members: int = MEMBERS) -> Committee:
    """Models from labelled whole texts, the seed sentences and unlabelled texts of the corpus, fitted one by one."""
    pools = pools_of(texts, labels, background or [])
    return Committee([_fit(pools, seed + k, epochs) for k in range(members)])


def all_texts(comments: DataFrame, generated: DataFrame) -> DataFrame:
    """table_name, record_id, source (subreddit or model) and text of the rows of both tables."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    run = F.coalesce(clean_id("run_id"), F.lit(""))
    record = F.when(F.col("comment_id").isNull(), F.concat_ws("/", run, key("post_id"))).otherwise(F.concat_ws("/", run, key("post_id"), key("comment_id")))
    return comments.select(F.lit("comments").alias("table_name"), own_id("comment_id").alias("record_id"), F.col("subreddit").alias("source"), F.col("body").alias("text")).unionByName(
        generated.select(F.lit("example_thread_format").alias("table_name"), record.alias("record_id"), F.col("model").alias("source"), F.col("content").alias("text"))
    )


def _sample(texts: DataFrame, most: int) -> list[str]:
    """At most `most` different texts, those with the smallest hashes. Only hashes are shuffled."""
    hashed = texts.where("text <> ''").select("text", F.xxhash64("text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return [] if last is None else sorted(r[0] for r in hashed.where(F.col("h") <= last).select("text").distinct().limit(most).collect())


def _packed(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def model_of(labels: DataFrame, texts: DataFrame, most: int = LABELS, most_background: int = BACKGROUND, folder: str | None = None) -> Committee:
    """The model of these labels and texts, fitted once: it is kept in the shared folder under a hash of what it was
    fitted on and of all parameters. Members are fitted in separate tasks."""
    spark = labels.sparkSession
    rows = labels.where("body is not null and is_abusive is not null").orderBy("sample_id", "body").limit(most).select("body", "is_abusive").collect()
    background = _sample(texts, most_background)
    source = [inspect.getsource(m) for m in (sys.modules[__name__], seeds)]
    named = xxhash.xxh3_128_hexdigest(repr((source, [tuple(r) for r in rows], background)).encode("utf-8", "surrogatepass"))
    path = f"{folder or shared_dir(spark)}/abuse-model-{named}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], background))

        def fit(batches):
            for b in batches:
                for k in b.id:
                    yield pd.DataFrame({"member": [k], "weights": [_packed(_fit(pools_of(*shared.value), 7 + int(k), EPOCHS))]})

        spark.range(0, MEMBERS, 1, MEMBERS).mapInPandas(fit, "member long, weights binary").write.mode("overwrite").parquet(path)
    found = spark.read.schema("member long, weights binary").parquet(path).orderBy("member").collect()  # MEMBERS rows
    return Committee([dict(np.load(io.BytesIO(bytes(r[1])))) for r in found])


def score_texts(texts: DataFrame, model: Committee) -> DataFrame:
    """table_name, record_id, source, score for rows of all_texts: the highest score of a text's overlapping windows.
    Null, empty and wordless texts score 0; repeated rows come out repeatedly. No shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(model.members)

    def score(batches):
        own = Committee(shared.value)
        for b in batches:
            found = b["text"].tolist()
            todo = list(dict.fromkeys(t for t in found if t))
            scores = dict(zip(todo, own.score(todo).tolist()))
            yield b.drop(columns="text").assign(score=[scores[t] if t else 0.0 for t in found])

    return texts.mapInPandas(score, "table_name string, record_id string, source string, score double")


def record_scores(scores: DataFrame) -> DataFrame:
    """table_name, record_id, source, score with one row per record: the highest score of its rows, and the least
    source. Rows without an id are no record."""
    return scores.where("record_id is not null").groupBy("table_name", "record_id").agg(F.min("source").alias("source"), F.max("score").alias("score"))


def abusive_records(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """table_name, record_id of the records with a text from the threshold on, each once."""
    return scores.where(F.col("score") >= threshold).where("record_id is not null").select("table_name", "record_id").distinct()


def abuse_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records, abusive records and their share per table and source."""
    return record_scores(scores).groupBy("table_name", "source").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("score") >= threshold).alias("n_abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate")
    )
