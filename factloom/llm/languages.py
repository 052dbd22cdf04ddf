"""Problem 10: the language of documents, sentences and mixed stretches, with a confidence.

A linear-chain conditional random field labels every word. Its features are the word's affixes, its
character n-grams, its script and its membership in short lexicons of function words; its transitions
learn how rarely the language changes from one word to the next. Posteriors come from forward-backward
over the whole document; a sentence takes the language with the largest share of its words' posteriors.

It is trained on the driver, on a bounded sample of labelled documents (``per_language`` each): sentences
are taken whose lexicon words agree with the label, and chained with sentences of other languages so that
transitions inside code-switched text are seen. Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "ru")
# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was it for with that this on are as but they have had not be at by from my our which would i you we he she after when were has been there their an or if than too so very only up out no can will should must may any each between within unless then just did do me us them his her its",
    "de": "der die das und ist nicht ein eine einen einem einer zu mit von dem den im auf für sich es ich wir sie er auch nach wie aber bei aus noch nur schon hat haben war sind sehr immer kein keine mein meine unser unsere ihn ihm wird als über vom zum zur dass wenn oder so habe alles viel man mehr doch ganz hier",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur avec au aux ce cette il elle je nous vous ils ne se son sa ses mon ma mes notre plus mais ou par été très bien tout encore après fait comme même si sont ont avait être trop aussi chez leur y c'est l'a jamais deux",
    "es": "el la los las de del un una y es en que no por con para su se lo al como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde desde nos todo mi yo fue era después son está mientras nuestro nuestra todavía uso dos demasiado ni tras estoy he ha",
    "it": "il lo la i gli le di del della dei delle un una uno e è in che non per con su si da al alla come più ma anche sono ho ha nel nella questo questa mio mia nostro nostra dopo ancora molto tutto se ci mi io era stato mentre troppo dal solo due sul davvero c'è l'ho quando ne nessuno",
    "nl": "de het een en van is niet in op te met voor dat die ik wij we zij ze hij aan er maar om ook als bij nog naar dan zo uit wat wel geen heeft hebben was zijn mijn ons onze deze dit na over al meer worden werd veel heel mij hem haar of tot toch door nu zonder goed terwijl alles steeds vond",
    "pt": "o a os as de do da dos das um uma e é em que não por com para se no na ao mais mas como foi ele ela eu nós já ou ser também muito seu sua meu minha nosso nossa depois ainda está são tem há sem quando entre até isso este esta pelo pela nos num numa dois duas todo tudo à às continua enquanto fica",
    "ru": "и в не на я что он она оно мы вы они с со как это по из к у за от но его её мне мой моя наш наша так все всё ещё уже только был была было были для же бы до если или при очень после даже без под через нет тоже сразу себе где когда чем о об",
}
# Other ways to write the languages.
LANGUAGE_NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano castilian", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands flemish", "pt": "por portuguese português portugues", "ru": "rus russian русский",
}
MISSING = ("", "und", "xx", "zxx", "mul", "unk", "unknown", "none", "null", "n/a", "na", "?", "-")
DIMENSIONS = 1 << 15
MOST_WORDS = 500_000
CHAINS_AT_ONCE = 128
_TOKEN = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*\s+|\s*[\r\n]+\s*)")
_LEXICON = {w: [] for ws in FUNCTION_WORDS.values() for w in ws.split()}
for _k, _l in enumerate(LANGUAGES):
    for _w in set(FUNCTION_WORDS[_l].split()):
        _LEXICON[_w].append(_k)


def normal_language(col: Column) -> Column:
    """One of the eight codes; "" where the label is missing; the label's first subtag where it names another language."""
    low = F.lower(F.btrim(F.coalesce(col, F.lit(""))))
    head = F.element_at(F.split(low, "[-_ ]"), 1)
    pairs = {name: code for code, names in LANGUAGE_NAMES.items() for name in [code, *names.split()]}
    mapping = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.when(low.isin(*MISSING), "").otherwise(F.coalesce(F.try_element_at(mapping, low), F.try_element_at(mapping, head), head))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE_END.split(text) if s and not s.isspace()]


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    w = f"^{word}$"
    out = [f"w{word}", "b"]
    out += [f"p{word[:k]}" for k in (1, 2, 3) if len(word) > k] + [f"s{word[-k:]}" for k in (1, 2, 3, 4) if len(word) > k]
    out += [f"g{w[i:i + 2]}" for i in range(len(w) - 1)] + [f"t{w[i:i + 3]}" for i in range(len(w) - 2)]
    out += [f"l{k}" for k in _LEXICON.get(word, ())] * 2
    out.append("c" + ("r" if "а" <= word[0] <= "я" or word[0] == "ё" else "a" if word.isascii() else "x"))
    return [zlib.crc32(f.encode()) % DIMENSIONS for f in out]


class Crf:
    """weights: DIMENSIONS x languages; trans: log potentials between successive labels; start: of the first."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.trans, self.start = weights, trans, start
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), np.float64)

    def __getstate__(self):
        return self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        """Drops the kept scores if they are many; row numbers given before hold no longer."""
        if len(self.seen) > MOST_WORDS:
            self.seen.clear()

    def types(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in ``rows``, where their emission scores are kept until ``forget``."""
        seen = self.seen
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(seen)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.weights[features(w)].sum(axis=0)
            out[i] = k
        return out


def posteriors(emission: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over padded chains: emission (n, T, L) scores, mask (n, T). Returns marginals and, if asked, expected transitions."""
    n, steps, size = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a = np.exp(trans)
    alpha = np.empty_like(e)
    x = e[:, 0] * np.exp(start)
    alpha[:, 0] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        x /= x.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], x, alpha[:, t - 1])
    beta = np.empty_like(e)
    beta[:, -1] = 1.0
    expected = np.zeros((size, size))
    for t in range(steps - 1, 0, -1):
        y = e[:, t] * beta[:, t]
        z = y @ a.T
        z /= z.sum(axis=1, keepdims=True)
        if pairs:
            joint = alpha[:, t - 1, :, None] * a[None] * y[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += (joint * mask[:, t, None, None]).sum(axis=0)
        beta[:, t - 1] = np.where(mask[:, t, None], z, beta[:, t])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return (gamma, expected) if pairs else gamma


def _vote(words: list[str]) -> int:
    """The language most function words of a sentence belong to, -1 without a clear one."""
    votes = np.zeros(len(LANGUAGES))
    for w in words:
        for k in _LEXICON.get(w, ()):
            votes[k] += 1 / len(_LEXICON[w])
    best = int(votes.argmax())
    second = np.sort(votes)[-2]
    return best if votes[best] >= 2 and votes[best] >= 1.3 * second else -1


def train(rows: list[tuple[str, str]], steps: int = 60, rate: float = 0.3, l2: float = 2e-4, seed: int = 3) -> Crf:
    """Fits the field to (text, language code) rows by full-batch AdaGrad on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    kept: list[tuple[list[str], int]] = []
    for text, code in rows:
        k = LANGUAGES.index(code)
        for s in sentences(text):
            words = [w.lower() for w in _TOKEN.findall(s)]
            if 4 <= len(words) <= 80 and _vote(words) == k:
                kept.append((words, k))
    # the function words alone keep the field usable where no sentence of a language was given
    for k, code in enumerate(LANGUAGES):
        words = FUNCTION_WORDS[code].split()
        kept += [(list(rng.permutation(words)[:12]), k) for _ in range(5)]
    order = rng.permutation(len(kept))
    chains, labels = [], []
    i = 0
    while i < len(order):
        take = order[i : i + int(rng.integers(1, 5))]
        i += len(take)
        chains.append([w for j in take for w in kept[j][0]])
        labels.append([kept[j][1] for j in take for _ in kept[j][0]])
    vocabulary: dict[str, int] = {}
    size = len(LANGUAGES)
    # chains of like length are scored together, so that little is spent on padding
    parts = []
    by_length = sorted(range(len(chains)), key=lambda c: len(chains[c]))
    for k in range(0, len(by_length), CHAINS_AT_ONCE):
        group = by_length[k : k + CHAINS_AT_ONCE]
        ids, gold, mask = (np.zeros((len(group), len(chains[group[-1]])), t) for t in (np.int64, np.int64, bool))
        for g, c in enumerate(group):
            ids[g, : len(chains[c])] = [vocabulary.setdefault(w, len(vocabulary)) for w in chains[c]]
            gold[g, : len(chains[c])] = labels[c]
            mask[g, : len(chains[c])] = True
        parts.append((ids, gold, mask))
    feats = [features(w) for w in vocabulary]
    sizes = np.array([len(f) for f in feats])
    owner, first = np.repeat(np.arange(len(feats)), sizes), np.cumsum(sizes) - sizes
    flat = np.concatenate([np.array(f) for f in feats])
    weights, trans, start = np.zeros((DIMENSIONS, size)), np.eye(size) * 2.0, np.zeros(size)
    hw, ht = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    observed = np.zeros((size, size))
    for _, gold, mask in parts:
        both = mask[:, 1:]
        np.add.at(observed, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    words_at, truth = (np.concatenate([p[i][p[2]] for p in parts]) for i in (0, 1))
    total = len(words_at)
    for _ in range(steps):
        scores = np.add.reduceat(weights[flat], first, axis=0)
        marginals, expected = zip(*[posteriors(scores[ids], mask, trans, start, pairs=True) for ids, _, mask in parts])
        expected = sum(expected)
        miss = -np.concatenate([g[p[2]] for g, p in zip(marginals, parts)])
        miss[np.arange(total), truth] += 1.0
        by_word = np.stack([np.bincount(words_at, miss[:, k], len(feats)) for k in range(size)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, k], DIMENSIONS) for k in range(size)], axis=1) / total - l2 * weights / 100
        gt = (observed - expected) / total
        hw += (grad * 100) ** 2
        ht += (gt * 100) ** 2
        weights += rate * grad * 100 / np.sqrt(hw)
        trans += rate * gt * 100 / np.sqrt(ht)
    return Crf(weights.astype(np.float32), trans, start)


def sample_labelled(docs: DataFrame, text: str, lang: str, doc_id: str, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` documents of each stated language, picked by a hash of their id: a bounded sample."""
    known = docs.select(F.col(text).alias("text"), normal_language(F.col(lang)).alias("code"), F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)).alias("pick"))
    known = known.where(F.col("code").isin(*LANGUAGES) & (F.length("text") > 20))
    share = {r[0]: min(1_000_000, int(1_000_000 * per_language / r[1]) + 1) for r in known.groupBy("code").count().collect()}
    if not share:
        return []
    limit = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])
    picked = known.where(F.col("pick") < F.try_element_at(limit, F.col("code"))).select("text", "code")
    return [tuple(r) for r in picked.limit(2 * per_language * len(share)).collect()]


SENTENCES = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_words", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


def label_texts(crf: Crf, texts: list[str | None], batch: int = 256) -> list[list[tuple]]:
    """For each text its sentences as (language, confidence, words, start, end), positions 1-based inclusive."""
    crf.forget()  # only here: the row numbers must hold until the texts are scored
    prepared = []
    for text in texts:
        spans, words, cut = [], [], 0
        if text:
            ends = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text)] + [(len(text), len(text))]
            for stop, nxt in ends:
                s = text[cut:stop]
                toks = [w.lower() for w in _TOKEN.findall(s)]
                if toks:
                    spans.append((len(words), len(words) + len(toks), len(_WORD.findall(s)), cut + 1, stop))
                    words += toks
                cut = nxt
        prepared.append((spans, crf.types(words)))
    out: list[list[tuple]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(prepared[i][1]))
    order = [i for i in order if len(prepared[i][1])]
    at = 0
    while at < len(order):
        group = order[at : at + batch]
        longest = len(prepared[group[-1]][1])
        if longest > 400 and len(group) > 16:  # few long texts at a time
            group = group[: max(1, min(len(group), 100_000 // longest))]
            longest = len(prepared[group[-1]][1])
        at += len(group)
        ids, mask = np.zeros((len(group), longest), np.int64), np.zeros((len(group), longest), bool)
        for g, i in enumerate(group):
            t = prepared[i][1]
            ids[g, : len(t)] = t
            mask[g, : len(t)] = True
        gamma = posteriors(crf.rows[ids], mask, crf.trans, crf.start)
        for g, i in enumerate(group):
            sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(gamma[g], axis=0)])
            for a, b, n, s, e in prepared[i][0]:
                share = (sums[b] - sums[a]) / (b - a)
                k = int(share.argmax())
                out[i].append((LANGUAGES[k], float(share[k]), n, s, e))
    return out


def label_documents(docs: DataFrame, text: str, crf: Crf, out: str = "sentences") -> DataFrame:
    """Adds ``out``: an array of the text's sentences with language, confidence, word count and place; empty for null or wordless texts."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    @F.pandas_udf(SENTENCES)
    def run(texts: pd.Series) -> pd.Series:
        model = shared.value
        names = SENTENCES.elementType.names
        rows = label_texts(model, [None if t is None or t != t else t for t in texts])
        return pd.Series([[dict(zip(names, s)) for s in r] for r in rows], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def document_languages(docs: DataFrame, doc_id: str, text: str, lang: str, crf: Crf, whole: int = 5) -> DataFrame:
    """doc_id, stated, lang, confidence, n_words, n_whole: a row per document and language of its sentences.

    n_words and confidence (weighted by words) cover the sentences in that language; n_whole counts those of ``whole``
    words or more. stated is the label in normal form. Repeated documents count once; texts without words give no row.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), normal_language(F.col(lang)).alias("stated")).where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    s = label_documents(d, "text", crf).select("doc_id", "stated", F.explode("sentences").alias("s")).select("doc_id", "stated", "s.*")
    return s.groupBy("doc_id", "stated", "lang").agg(
        (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"), F.sum("n_words").alias("n_words"), F.count_if(F.col("n_words") >= whole).alias("n_whole"),
    )


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages with a whole sentence, of documents whose label is missing, not among them, or one of several."""
    whole = found.where("n_whole > 0")
    about = whole.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("stated").alias("stated"))
    bad = about.where((F.col("stated") == "") | ~F.array_contains("langs", F.col("stated")) | (F.size("langs") > 1))
    return bad.select("doc_id", F.explode("langs").alias("lang"))
