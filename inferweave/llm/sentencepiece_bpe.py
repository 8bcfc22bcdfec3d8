"""SentencePiece encoding and decoding for merge-type vocabularies.

The merge rule: all adjacent symbol pairs whose concatenation is in the vocabulary stand on an agenda ordered by
score (highest first, then leftmost); the best pair that still exists is merged and its new neighbours go on the
agenda, until none is left. Symbols outside the vocabulary fall back to bytes.

No piece of such a vocabulary holds the space mark after another character (checked on loading), so no merge crosses
the start of a run of space marks, and texts are encoded run by run ("words"). A worker keeps the ids of short words
it has met, up to MEMO entries, and forgets them when another operator begins in it. Words new to a worker are encoded by the agenda and, in the same Arrow batch, by the
sentencepiece library; a difference is an error. Memory is bounded by one Arrow batch and the memo.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from inferweave.llm.common import release_memory, rows_of, ship_package, table, worker_memo

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words of at most so many characters keep their agenda as a list.
SHORT, NEVER = 28, 1 << 60
#: A worker's memo: so many words of at most so many characters, at most some 250 bytes each.
MEMO, LONG = 600_000, 48


def utf8(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


class MergeModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a merge-type model without normalization rules and with a leading space mark is needed")
        kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
        if bad := {p.type for p in proto.pieces} - set(kinds):
            raise ValueError(f"piece types {sorted(bad)} aren't supported")
        self.pieces = [(p.piece, kinds[p.type]) for p in proto.pieces]
        self.ids = {p: i for i, (p, kind) in enumerate(self.pieces) if kind == "normal"}
        self.scores = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(self.pieces) if kind == "byte"}
        self.unknown = next(i for i, (_, kind) in enumerate(self.pieces) if kind == "unknown")
        self._number_pairs()
        self.plain = frozenset(self.ids.values())
        self.texts = [p.replace(SPACE, " ") for p, _ in self.pieces]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def merge(self, word: str) -> list[int]:
        """Ids of a text in which spaces are space marks already."""
        if len(word) <= SHORT and word[:2] != SPACE + SPACE:
            return self.merge_short(word)
        return self.ids_of(self.merge_long(word))

    def _number_pairs(self) -> None:
        """For merge_short: symbols as numbers, and for each pair of symbols that a piece is made of the piece's rank and number.

        Characters that only stand inside pieces get numbers after the vocabulary's.
        """
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        ranks = {score: i for i, score in enumerate(sorted({s for p, s in self.scores.items() if p.strip(SPACE)}))}
        if len(ranks) != sum(bool(p.strip(SPACE)) for p in self.ids):
            raise ValueError("pieces share a score")
        self.symbols = symbols
        self.pairs = {}
        for p, i in self.ids.items():
            if p.strip(SPACE):
                for k in range(1, len(p)):
                    if (x := symbols.get(p[:k])) is not None and (y := symbols.get(p[k:])) is not None:
                        self.pairs[x << 20 | y] = ranks[self.scores[p]] << 20 | i

    def merge_short(self, word: str) -> list[int]:
        """The agenda as a list of numbers that stands beside the symbols: for a few pairs, its least entry is found faster than a heap is kept.

        Not for runs of space marks, whose pieces share a score.
        """
        get, pairs = self.symbols.get, self.pairs.get
        symbols = [get(c, -1) for c in word]
        if -1 in symbols:
            return self.ids_of(self.merge_long(word))
        agenda = [pairs(x << 20 | y, NEVER) for x, y in zip(symbols, symbols[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost
            piece = symbols[i] = best & 0xFFFFF
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = pairs(piece << 20 | symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = pairs(symbols[i - 1] << 20 | piece, NEVER)
        if max(symbols) >= len(self.pieces):
            return self.ids_of(self.merge_long(word))
        return symbols

    def merge_long(self, word: str) -> list[str]:
        """The agenda as a heap, whose entries are checked when they come up: pairs may have gone meanwhile."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            if (pair := word[i : i + 2]) in scores:
                agenda.append((scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, pair = pop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (new := pair + symbols[k]) in scores:
                    push(agenda, (scores[new], i, k, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in scores:
                push(agenda, (scores[new], h, i, new))
        return [s for s in symbols if s is not None]

    def ids_of(self, symbols: list[str]) -> list[int]:
        ids = self.ids
        out = [ids.get(s) for s in symbols]
        if None in out:
            out = []
            for s in symbols:
                if (x := ids.get(s)) is not None:
                    out.append(x)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in s.encode("utf-8", "surrogatepass"))
                else:
                    out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [x for w in WORDS.findall(SPACE + text.replace(" ", SPACE)) for x in self.merge(w)]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: runs of byte pieces as UTF-8 (a bad byte gives U+FFFD), without the leading space."""
        if self.plain.issuperset(ids):
            text = "".join([self.texts[x] for x in ids])
            return text[1:] if ids and self.pieces[ids[0]][0][0] == SPACE else text
        out, run, first = [], bytearray(), True
        for x in ids:
            piece, kind = self.pieces[x]
            if kind == "byte":
                run.append(int(piece[3:5], 16))
                first = False
                continue
            if run:
                out.append(utf8(run))
                run.clear()
            if kind == "control":
                continue
            if kind == "unknown":
                out.append(" ⁇ ")
            else:
                out.append((piece[1:] if first and piece[:1] == SPACE else piece).replace(SPACE, " "))
            first = False
        if run:
            out.append(utf8(run))
        return "".join(out)


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> MergeModel:
    return MergeModel(path)


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its memo serves all tasks that the worker runs."""
    return worker_memo(("sentencepiece", path), lambda: WordEncoder(MergeModel(path)))


class WordEncoder:
    """Encodes words, each new one by the agenda and checked against the library.

    An entry is the ids as text, with the decoded text beside it if that isn't the word with spaces for its marks.

    The memo has two generations: when the young one is full it becomes the old one, so that frequent words stay.
    """

    def __init__(self, model: MergeModel):
        self.model = model
        self.names = [str(i) for i in range(len(model.pieces))]
        self.young: dict[str, str | tuple[str, str]] = {}
        self.old: dict[str, str | tuple[str, str]] = {}

    def learn(self, words: list[str]) -> dict[str, str | tuple[str, str]]:
        """Entries of words, all new."""
        model, out, names = self.model, {}, self.names
        theirs = model.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1) if words else []
        for w, other in zip(words, theirs, strict=True):
            ids = model.merge(w)
            if ids != other and (len(w) > 1 or other):  # the library gives nothing for an empty text
                raise ValueError(f"the agenda and the library differ on {w[:80]!r}")
            # The decoder drops one space mark at the start; a mark put in front keeps the word's own.
            joined, decoded = ",".join([names[x] for x in ids]), model.decode([model.ids[SPACE], *ids])
            out[w] = joined if decoded == w.replace(SPACE, " ") else (joined, decoded)
        return out

    def encode_chunk(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, ids as text, decoded text."""
        split = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        young, old = self.young, self.old
        distinct = set()
        distinct.update(*split)
        entries = {w: young.get(w) for w in distinct}
        late = {w: old.get(w) for w, e in entries.items() if e is None}
        late |= self.learn([w for w, e in late.items() if e is None])
        entries |= late
        if len(young) > MEMO // 2:
            self.old, self.young = young, {}
        self.young.update((w, e) for w, e in late.items() if len(w) <= LONG)
        out = []
        for words, text in zip(split, texts, strict=True):
            found = [entries[w] for w in words]
            try:
                joined, decoded = ",".join(found), text.replace(SPACE, " ") if words else ""
            except TypeError:  # some words aren't decoded to themselves
                pairs = [(e, w.replace(SPACE, " ")) if isinstance(e, str) else e for w, e in zip(words, found, strict=True)]
                joined, decoded = ",".join(p[0] for p in pairs), "".join(p[1] for p in pairs)[1:]
            out.append((joined.count(",") + 1 if words else 0, joined, decoded))
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """As encode_chunk, some 800,000 characters at a time, so that the words of a batch never stand in memory together."""
        chunk, size = [], 0
        for t in texts:
            chunk.append(t)
            size += len(t or "")
            if size > 800_000:
                yield from self.encode_chunk(chunk)
                chunk, size = [], 0
        yield from self.encode_chunk(chunk)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) with n_tokens, ids_sha256 and decoded_sha256; with_ids adds the ids (array<int>) and the decoded text.

    Null texts are empty texts: no ids, digests of nothing. An empty table gives an empty table; repeated rows, ties and
    other columns of docs don't matter: only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator):
        import pyarrow as pa

        encoder = worker_encoder(model_path)
        for batch in batches:
            (ids, texts), out = next(rows_of([batch], "doc_id", "text")), []
            for doc_id, (n, joined, decoded) in zip(ids, encoder.encode_batch(texts), strict=True):
                row = (doc_id, n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                out.append(row + (([int(x) for x in joined.split(",") if x], decoded) if with_ids else ()))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6 if with_ids else 4)]
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32()), pa.string()] if with_ids else [])
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(types)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded with the public merge-type vocabulary."""
    return encode_documents(table(spark, sf_dir, "documents"), public_model())
