"""Phrases of a lexicon in texts, found by a trie of words that is walked inside each row.

The lexicon is checked to be small before it is sent to the workers; the words of a text are told apart
by the same expression as everywhere else (functions.text), on the JVM. Only hits leave a row, so there
is no shuffle of phrases. Lexicons too large for that are joined with all phrases of each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.columns import own_names
from evigraph.functions import text as T
from evigraph.operators.relational import is_small
from evigraph.workers import ship

ship(__name__)

#: Marks the end of a phrase in the trie; a word is a text.
END = None
#: So many first words of phrases are looked for in the whole text, before its words are told apart.
FIRST_WORDS = 64


def trie(phrases: Iterable[str]) -> dict:
    """Nested dicts by word; at the end of a phrase END leads to the phrase."""
    root: dict = {}
    for p in phrases:
        node = root
        for w in p.split(" "):
            node = node.setdefault(w, {})
        node[END] = p
    return root


def hits(root: dict, words: Sequence[str]) -> dict[str, None]:
    """Distinct phrases in a run of words, in the order of their first words."""
    found: dict[str, None] = {}
    for i, w in enumerate(words):
        node, k = root.get(w), i
        while node:
            if END in node:
                found[node[END]] = None
            k += 1
            node = node.get(words[k]) if k < len(words) else None
    return found


def walker(phrases: Sequence[str], words: str, name: str):
    """For mapInArrow: rows with an array of words to a row for each hit."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie(phrases)
        for batch in batches:
            at, found = [], []
            for i, row in enumerate(batch.column(words).to_pylist()):
                for p in hits(root, row or ()):
                    at.append(i)
                    found.append(p)
            rest = pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, batch.schema.names) if n != words], names=[n for n in batch.schema.names if n != words])
            taken = rest.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*taken.schema.names, name])

    return walk


def phrase_hits(rows: DataFrame, keys: Sequence[str], text: Column, lexicon: DataFrame, phrase: str = "phrase", longest: int = 4) -> DataFrame:
    """(keys, phrase, other columns of the lexicon): each distinct phrase of the lexicon in each text.

    A phrase is one to `longest` words as T.phrase_words() tells them apart, in lower case, joined by
    single blanks. A lexicon may name a phrase several times, with other columns each. Null text has
    no words; null phrases, and those longer than that, match nothing.
    """
    (words,) = own_names([*keys, *lexicon.columns], "words")
    lexicon = lexicon.filter(F.col(phrase).isNotNull())
    if not is_small(lexicon):
        spans = rows.select(*keys, F.explode(T.word_phrases(text, longest)).alias(phrase))
        return spans.join(lexicon, phrase).select(*keys, *lexicon.columns)
    known = [r[0] for r in lexicon.select(phrase).distinct().collect()]
    known = sorted(p for p in known if p and p.count(" ") < longest)
    firsts = sorted({p.split(" ")[0] for p in known})
    if len(firsts) <= FIRST_WORDS:
        # what holds no first word of a phrase needs no worker
        rows = rows.filter(reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in firsts], F.lit(False)))
    given = rows.select(*keys, F.coalesce(T.phrase_words(text), F.array().cast("array<string>")).alias(words))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != words)
    found = given.mapInArrow(walker(known, words, phrase), f"{schema}, `{phrase}` string")
    return found.join(F.broadcast(lexicon), phrase).select(*keys, *lexicon.columns)
