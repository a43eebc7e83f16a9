"""Languages of documents and of their segments, with a confidence (problem 8).

Method: Bayesian evidence fusion. The likelihood of a sentence's words and letters under each language is combined with
what the label declares, with a language suffix in the address, and with the prior of the host (the collection a document comes from), smoothed
towards its parents: collection and kind of document, then collection, then all documents. Priors are grouped counts over all rows.

The likelihoods come from a naive Bayes model over hashed words and letter triples. It is fitted on a sample of labelled rows of at most
``SAMPLE_ROWS`` rows, chosen by a hash of the id; wrong labels are outweighed by relabelling the sample's sentences with the first fit and fitting again.
The model has a fixed size (``BUCKETS`` times the number of languages) and travels inside the function.

Defined results: null, empty and blank texts, code, tables and single words have no segments and keep their usable label with the
prior as confidence; ties go to the first language in order; labels are read in any notation listed, others name none; repeated rows get equal answers;
texts are read whole; a null source, kind or path is a host of its own or no evidence; a host without a label takes the prior of its collection.
Sentences below ``SURE`` join the segment before them if their evidence together keeps its language, and else are segments with the low
confidence they have; a segment tells how many of its sentences are sure (``n_sure``), and only languages of sure sentences count as found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.session import checkpointed

# The languages told apart, with the names and codes that labels use for them.
LABELS = {
    "de": "de deu ger german deutsch allemand alemán tedesco duits tyska niemiecki немецкий",
    "en": "en eng english englisch anglais inglés ingles inglese engels engelska angielski английский",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo spaans spanska hiszpański испанский",
    "fr": "fr fra fre french français francais französisch francés francese frans franska francuski французский",
    "it": "it ita italian italiano italienisch italien italiaans italienska włoski итальянский",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés olandese nederländska niderlandzki нидерландский",
    "pl": "pl pol polish polski polnisch polonais polaco polacco pools polska польский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portoghese portugees portugisiska portugalski португальский",
    "ru": "ru rus russian русский russisch russe ruso russo ryska rosyjski",
    "sv": "sv swe swedish svenska schwedisch suédois sueco svedese zweeds szwedzki шведский",
}
LANGUAGES = tuple(LABELS)
# Frequent short words of each language, a little evidence before any text is seen.
FREQUENT = {
    "de": "der die das und ist nicht ein eine den dem mit auf für von zu sich wird wenn damit weil nach noch nur man kann bitte",
    "en": "the and is not a an of to in for with that this it on as are was be by from which after only can please when",
    "es": "el la los las y es no un una de que en con para por se lo como más pero después solo puede porque cuando",
    "fr": "le la les et est ne pas un une des du de que dans avec pour par se ce sur plus mais après seulement peut car quand",
    "it": "il lo la i gli le e è non un una di che in con per si come più ma dopo solo può perché quando della",
    "nl": "de het een en is niet van te dat op met voor zijn er aan maar na alleen kan omdat wanneer nog ook wordt dit",
    "pl": "i w nie na się z do jest to że dla po tylko jak ale można gdy od za przez oraz ponieważ jeszcze tego ma",
    "pt": "o a os as e é não um uma de que em com para por se mais mas depois só pode porque quando dos da ao",
    "ru": "и в не на что с это для по только как но можно если от за из после к у же бы он все ещё так",
    "sv": "och är inte en ett den det som på av för med till att om men efter bara kan eftersom när från vi har ska",
}
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 16
#: Hosts whose priors are broadcast at most; the priors of more are joined with a shuffle.
BROADCAST_HOSTS = 100_000
#: Words a worker remembers the evidence of.
REMEMBERED = 100_000
#: Words a sentence has at least, and the confidence from which it counts.
SENTENCE_WORDS, SURE = 3, 0.95
#: How far a label is trusted, how far a language suffix, and rows that a parent's prior weighs as.
LABEL_TRUST, SUFFIX_TRUST, PARENT_ROWS = 0.7, 0.9, 50.0
#: What one letter triple weighs against a word.
TRIPLE_WEIGHT = 0.4

_FENCE = re.compile(r"^\s*(```|~~~)")
_BULLET = re.compile(r"^\s*(?:>+\s*)?(?:[-*+•–]\s+|\d+[.)]\s+|\[[ xX]\]\s+|#{1,6}\s+|//+\s*|/\*+\s*|--+\s+|/\s+|;+\s+|\"\"\"|'''|%\s+)*(?:\[\d{4}-\d\d-\d\d[^\]]*\]\s*)?")
_COMMENT = re.compile(r"^\s*(?:#+|//+|--|/\*+|\*|;+|%|\"\"\"|''')\s*(?P<t>\S.*?)\s*(?:\*/|\"\"\"|''')?\s*$")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_DROP = re.compile(
    r"`[^`\n]*`|\(\s*[\"“'«][^\"”'»()]*[\"”'»]\s*\)|<[^<>\n]{1,80}>|https?://\S+|(?<!\w)--?[\w-]+|(?<![\w.-])[\w.-]*[/\\][\w./\\-]*\w|\b\w+\(\)?|\b\w*_\w*|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z0-9]+[A-Z]\w*|(?<![\w-])[\w-]+\.(?:py|md|ts|js|json|ya?ml|toml|sh|go|sql|css|mjs)\b"
)
#: A sign that something of ``_DROP`` may be there.
_SUSPECT = re.compile(r"[`(<_/\\]|[a-z0-9][A-Z]|[\w-]\.[a-z]|(?<!\w)-[\w-]")
_LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])|[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_STOP = re.compile(r"[.!?…][\"”»')\]]*(?:\s+|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOPS, _CLOSERS = tuple(".!?…"), "'\"”»)]"
_CODE = re.compile(r"[{};=<>|\\@$^~]|\w\(|\)\.|\[\w*\]|::|->|&&")
#: A sign that something of ``_CODE`` may be there.
_CODE_SIGN = re.compile(r"[{};=<>|\\@$^~(\[):&]")
_ODD = re.compile(r"[​-‏­﻿️⃠-⃿]|[\U0001F000-\U0001FAFF]|[☀-➿]")


def usable_label(label: Column) -> Column:
    """The two-letter language a label names, in whatever notation; null where it names none of those told apart."""
    key = F.regexp_replace(F.lower(F.trim(label)), r"^\s+|\s+$", "")
    head = F.regexp_extract(key, r"^([^\s_\-,;/(.]+)", 1)
    names = {name: code for code, all_names in LABELS.items() for name in all_names.split()}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[head]


def suffix_language(path: Column) -> Column:
    """The language in an address: a suffix before the ending, or a directory of its own."""
    found = F.regexp_extract(F.lower(path), rf"(?:[._]|(?:^|/))({'|'.join(LANGUAGES)})(?:[._-][a-z]{{2}})?(?:\.[a-z]+$|/)", 1)
    return F.when(found != "", found)


def prose_of(line: str) -> str:
    """A line without code words, paths, quoted terms, emoji and invisible characters."""
    line = line if line.isascii() else _ODD.sub("", line)
    return _DROP.sub(" ", line) if _SUSPECT.search(line) else line


def ends(piece: str) -> bool:
    """Whether a piece ends like a sentence; closing quotes and brackets may follow the stop."""
    return piece.rstrip().rstrip(_CLOSERS).endswith(_STOPS)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of prose in a text; code gives only the sentences in its comments."""
    fenced = False
    at = 0
    for line in _LINE.findall(text):
        start, at = at, at + len(line)
        if _FENCE.match(line):
            fenced = not fenced
            continue
        comment = False
        if fenced:
            m = _COMMENT.match(line)
            if not m:
                continue
            shift, body, comment = m.start("t"), m["t"], True
        else:
            if _HEADING.match(line) and not ends(line):
                continue
            shift = _BULLET.match(line).end()
            body = line[shift:]
        if not body.strip():
            continue
        pos = 0
        for part in [*(m.end() for m in _STOP.finditer(body)), len(body)]:
            piece = body[pos:part]
            if piece.strip():
                clean = prose_of(piece)
                small = clean.lower()
                words = _WORD.findall(small if small.isascii() else unicodedata.normalize("NFC", small))
                letters = sum(map(len, words))
                whole = ends(piece)
                signs = len(_CODE.findall(clean)) if _CODE_SIGN.search(clean) else 0
                if (
                    len(words) >= SENTENCE_WORDS
                    and (whole or not comment and len(words) >= 6)
                    and letters >= 0.5 * len(clean.replace(" ", ""))
                    and signs * 6 <= len(words)
                ):
                    yield start + shift + pos, start + shift + part, words
            pos = part


def buckets_of(word: str) -> tuple[int, list[int]]:
    """The bucket of a word and those of its letter triples."""
    padded = f"<{word}>"
    return zlib.crc32(word.encode()) % BUCKETS, [zlib.crc32(b"3" + padded[i : i + 3].encode()) % BUCKETS for i in range(len(padded) - 2)]


class Model:
    """Log likelihoods of hashed words and letter triples under each language."""

    def __init__(self, words: np.ndarray, triples: np.ndarray):
        seen_words, seen_triples = words.copy(), triples.copy()
        for n, name in enumerate(LANGUAGES):
            for word in FREQUENT[name].split():
                one, three = buckets_of(word)
                seen_words[one, n] += 5
                for b in three:
                    seen_triples[b, n] += 2
        self.words, self.triples = self._log(seen_words, 0.02), self._log(seen_triples, 0.05)
        self.forget()

    def forget(self) -> None:
        self._row: dict[str, int] = {}
        self._rows = np.zeros((0, len(LANGUAGES)), dtype=np.float32)

    def __getstate__(self) -> tuple:
        return self.words, self.triples

    def __setstate__(self, state: tuple) -> None:
        self.words, self.triples = state
        self.forget()

    @staticmethod
    def _log(counts: np.ndarray, floor: float) -> np.ndarray:
        rates = (counts + floor) / (counts + floor).sum(axis=0, keepdims=True)
        logs = np.log(rates)
        return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        places = self.places(words)  # may make new rows
        return self._rows[places].sum(axis=0)

    def score_all(self, sentences_of: list[list[str]]) -> np.ndarray:
        """The scores of sentences, none of them without words; one sum over the words of a text."""
        places = self.places([word for words in sentences_of for word in words])  # may make new rows
        begins = np.cumsum([0, *map(len, sentences_of[:-1])])
        return np.add.reduceat(self._rows[places], begins, axis=0)

    def places(self, words: list[str]) -> list[int]:
        """The rows of ``_rows`` that hold the evidence of the words."""
        try:
            return [self._row[word] for word in words]
        except KeyError:
            if len(self._row) > REMEMBERED:
                self.forget()
            for word in words:
                if word not in self._row:
                    place = self._row[word] = len(self._row)
                    if place >= len(self._rows):
                        self._rows = np.concatenate([self._rows, np.zeros((max(1024, len(self._rows)), len(LANGUAGES)), dtype=np.float32)])
                    one, three = buckets_of(word)
                    self._rows[place] = self.words[one] + TRIPLE_WEIGHT * self.triples[three].sum(axis=0) / max(1.0, len(three) / 4)
            return [self._row[word] for word in words]


def _split_labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of labelled texts, as words."""
    for batch in batches:
        found = [(label, words) for text, label in zip(batch["text"], batch["label"]) for _, _, words in sentences(text)]
        yield pd.DataFrame(found, columns=["label", "words"])


def _counts(split: DataFrame, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words and triples by language over labelled sentences; labels are of the row, or of each sentence where a model is given."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.zeros((2, BUCKETS, len(LANGUAGES)))
        order = {name: n for n, name in enumerate(LANGUAGES)}
        seen: Counter = Counter()

        def settle() -> None:
            for (word, n), times in seen.items():
                one, three = buckets_of(word)
                tables[0, one, n] += times
                for b in three:
                    tables[1, b, n] += times
            seen.clear()

        for batch in batches:
            for label, words in zip(batch["label"], batch["words"]):
                n, words = order[label], list(words)
                if model is not None:
                    score = model.score(words)
                    score[n] += 3.0  # the label is evidence too
                    n = int(score.argmax())
                seen.update([(word, n) for word in words])
            if len(seen) > REMEMBERED:
                settle()
        settle()
        kind, b, n = np.nonzero(tables)
        yield pd.DataFrame({"kind": kind.astype("int32"), "bucket": b.astype("int32"), "lang_no": n.astype("int32"), "n": tables[kind, b, n]})

    # at most two tables of BUCKETS rows per language reach the driver, whatever the corpus
    found = split.mapInPandas(count, "kind int, bucket int, lang_no int, n double").groupBy("kind", "bucket", "lang_no").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((2, BUCKETS, len(LANGUAGES)))
    tables[found["kind"].to_numpy(), found["bucket"].to_numpy(), found["lang_no"].to_numpy()] = found["n"].to_numpy()
    return tables[0], tables[1]


def host_counts(documents: DataFrame) -> DataFrame:
    """Labelled rows by language of every collection and kind (level 0), every collection (1) and all documents (3): one pass over all rows, kept."""
    held = documents.select("source", "doc_kind", usable_label(F.col("lang")).alias("label"))
    counts = [F.count_if(F.col("label") == name).cast("double").alias(name) for name in LANGUAGES]
    return checkpointed(held.rollup("source", "doc_kind").agg(F.grouping_id().alias("level"), *counts))


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, counts: DataFrame | None = None) -> Model:
    """A model from at most about ``sample_rows`` labelled rows of (doc_id, text, lang), chosen by a hash of the id; their sentences are split once."""
    labelled = documents.select("doc_id", "text", usable_label(F.col("lang")).alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    every = (host_counts(documents) if counts is None else counts).where("level = 3").first()
    total = sum(every[x] for x in LANGUAGES) if every else 0
    if total > sample_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / total))
    split = checkpointed(labelled.mapInPandas(_split_labelled, "label string, words array<string>"))
    first = Model(*_counts(split, None))
    return Model(*_counts(split, first))


def host_priors(counts: DataFrame) -> DataFrame:
    """(host_source, host_kind, host_prior): log priors of each host's languages, smoothed towards the collection's and those towards all documents'."""
    every = counts.where("level = 3").first()
    total = sum(every[x] for x in LANGUAGES) if every else 0.0
    share = {x: ((every[x] if every else 0.0) + 1) / (total + len(LANGUAGES)) for x in LANGUAGES}
    smoothed = lambda own, weight: ((own + PARENT_ROWS * weight) / (F.col("total") + PARENT_ROWS))
    summed = counts.withColumn("total", sum(F.col(x) for x in LANGUAGES))
    source = summed.where("level = 1").select(F.col("source").alias("parent"), *[smoothed(F.col(x), F.lit(share[x])).alias(f"of_{x}") for x in LANGUAGES])
    joined = summed.where("level = 0").join(source, F.col("source").eqNullSafe(F.col("parent")))
    return joined.select(F.col("source").alias("host_source"), F.col("doc_kind").alias("host_kind"), F.array(*[F.log(smoothed(F.col(x), F.col(f"of_{x}"))) for x in LANGUAGES]).alias("host_prior"))


SEGMENTS = "array<struct<start:int,end:int,n_sentences:int,n_sure:int,lang:string,confidence:double>>"


def _chance(evidence: np.ndarray, lang: str) -> float:
    """The probability of a language."""
    logs = evidence.tolist()
    top = max(logs)
    return exp(logs[LANGUAGES.index(lang)] - top) / sum(exp(x - top) for x in logs)


def segment(text: str, model: Model, prior: np.ndarray) -> list[dict]:
    """Segments of a text: runs of sentences of one language, with the confidence of their joined evidence."""
    found = list(sentences(text))
    if not found:
        return []
    scores = model.score_all([words for _, _, words in found])
    evidence = scores + prior
    tops = evidence.argmax(axis=1)
    chances = (1.0 / np.exp(evidence - evidence.max(axis=1, keepdims=True)).sum(axis=1)).tolist()
    out: list[dict] = []
    joined = prior  # evidence of the last segment, the prior counted once
    for (start, end, _), score, n, chance in zip(found, scores, tops.tolist(), chances):
        sure = int(chance >= SURE)
        if not sure and out:
            together = int((joined + score).argmax())
            n = together if LANGUAGES[together] == out[-1]["lang"] else n
        lang = LANGUAGES[n]
        if out and out[-1]["lang"] == lang:
            last = out[-1]
            last["end"] = end
            last["n_sentences"] += 1
            last["n_sure"] += sure
            joined = joined + score
        else:
            if out:
                out[-1]["confidence"] = _chance(joined, out[-1]["lang"])
            out.append({"start": start, "end": end, "n_sentences": 1, "n_sure": sure, "lang": lang, "confidence": 0.0})
            joined = prior + score
    out[-1]["confidence"] = _chance(joined, out[-1]["lang"])
    return out


def _segments(model: Model):
    @F.pandas_udf(SEGMENTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        flat = np.zeros(len(LANGUAGES))
        order = {name: n for n, name in enumerate(LANGUAGES)}

        def evidence(name: str | None, trust: float) -> np.ndarray:
            if name is None:
                return flat
            out = np.full(len(LANGUAGES), np.log((1 - trust) / (len(LANGUAGES) - 1)))
            out[order[name]] = np.log(trust)
            return out

        for texts, labels, suffixes, priors in batches:
            yield pd.Series(
                [
                    segment(t, model, (np.asarray(p, dtype=float) if p is not None else flat) + evidence(a, LABEL_TRUST) + evidence(s, SUFFIX_TRUST)) if t else []
                    for t, a, s, p in zip(texts, labels, suffixes, priors)
                ],
                dtype=object,
            )

    return run


def label_documents(documents: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, segments) of every row; the prior of the host and of the label are part of the evidence of each sentence."""
    rows = documents.select("doc_id", "text", "source", "doc_kind", usable_label(F.col("lang")).alias("label"), suffix_language(F.col("rel_path")).alias("suffix"))
    counts = host_counts(documents) if counts is None else counts
    priors = host_priors(counts)
    if counts.count() <= BROADCAST_HOSTS:  # else texts move to their host's prior, and the planner splits hosts that are too large
        priors = F.broadcast(priors)
    joined = rows.join(priors, F.col("source").eqNullSafe(F.col("host_source")) & F.col("doc_kind").eqNullSafe(F.col("host_kind")), "left")
    return joined.select("doc_id", "label", "host_prior", _segments(model)("text", "label", "suffix", "host_prior").alias("segments"))


def document_languages(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_sentences): the main language of each document, or its label where it has no prose."""
    best = F.expr(
        "aggregate(transform(array_distinct(transform(segments, s -> s.lang)), l -> named_struct('n', aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.n_sentences), "
        "'confidence', array_max(transform(filter(segments, s -> s.lang = l), s -> s.confidence)), 'lang', l)), "
        "named_struct('n', 0, 'confidence', cast(0 AS double), 'lang', cast(null AS string)), (a, x) -> if(x.n > a.n, x, a))"
    )
    place = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("label"))
    prior = F.when(place > 0, F.exp(F.element_at("host_prior", place.cast("int"))))
    return labelled.withColumn("best", best).select(
        "doc_id",
        F.coalesce("best.lang", "label").alias("lang"),
        F.when(F.col("best.n") > 0, F.col("best.confidence")).otherwise(prior).alias("confidence"),
        F.col("best.n").alias("n_sentences"),
    )


def unnamed_languages(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang): languages a document has a full sentence in and its label does not name."""
    found = labelled.select("doc_id", "label", F.explode(F.array_distinct(F.filter("segments", lambda s: s["n_sure"] > 0)["lang"])).alias("lang"))
    return found.where(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id", "lang").distinct()


def segments_of(labelled: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_sentences, n_sure, lang, confidence): one row per segment, character offsets."""
    return labelled.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.start", "s.end", "s.n_sentences", "s.n_sure", "s.lang", "s.confidence")
