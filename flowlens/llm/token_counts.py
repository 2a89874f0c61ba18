"""Word-piece counts by a linear longest-match automaton that builds no pieces."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import small_batches, spread_rows

#: A vocabulary file of a public tokenizer; another may be named.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks a piece that starts a word.
WORD_START = "▁"
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 1 << 17


def read_pieces(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that start words, without their mark, and pieces that go on, from a sentencepiece model file.

    The mark alone is a piece too, here the empty text: it starts words that no longer piece does.
    Control and byte pieces stand for no characters and are left out. The driver reads the file; its
    size bounds what is sent to the workers.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or not piece:
            continue
        if piece.startswith(WORD_START):
            if WORD_START not in piece[1:]:
                first.append(piece[1:])
        elif WORD_START not in piece:
            later.append(piece)
    return first, later


class LongestMatch:
    """Greedy longest-match word pieces, counted in one pass over the characters.

    Two tries share one array of nodes: node 0 starts words, node 1 goes on. When a node has no edge
    for a character, the pieces that longest match would have cut by then are popped: how many is
    precomputed, as is the node that stands for the characters left over, the failure link. Node 0
    stands for the mark of a word's start: an empty text in ``first`` makes it a piece, which fails over
    to node 1.
    """

    def __init__(self, first: list[str], later: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.edges[at].get(c)
                    if nxt is None:
                        nxt = self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    at = nxt
                final[at] = final[at] or bool(piece)
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        if "" in first:
            self.fail[0], self.pops[0] = 1, 1
        queue = [0, 1]
        for u in queue:  # grows as it is read: nodes by depth
            for c, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if longest match can't cut the whole of it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 0
            u = v
        while u > 1:  # the end of the word pops what is left
            n += pops[u]
            u = fail[u]
        return n if u == 1 else 0


@lru_cache(maxsize=2)
def _automaton(first: tuple, later: tuple) -> LongestMatch:
    return LongestMatch(list(first), list(later))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), one row per row of ``docs``, from whole texts.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs without ASCII white
    space; a word that the pieces can't cut is one unknown token, as in WordPiece. Null and empty
    texts have zeros. Repeated rows stay; an empty table gives an empty result. Time is linear in the
    characters, however long a word is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tuple(p) for p in read_pieces(vocabulary)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = _automaton(*shared.value).count
        known: dict[bytes, int] = {}
        for batch in small_batches(batches):
            words_n, tokens_n, unknown_n = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                tokens = unknown = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = count(word.decode("utf-8", "surrogatepass"))
                        if len(word) < 100:
                            known[word] = n
                    tokens += n or 1
                    unknown += not n
                words_n.append(len(words))
                tokens_n.append(tokens)
                unknown_n.append(unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words_n, tokens_n, unknown_n))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return (spread_rows(docs).select("doc_id", F.col("text"))
            .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"))
