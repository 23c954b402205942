"""Exact best parts of every question, found beside the postings.

Parts are placed: all postings of a part are in one partition. A partition turns its postings into lists, one
a term, cut into blocks of `BLOCK` postings with the largest gain of each. A question reads the lists of its
terms by falling upper bound, the rare ones first. As soon as the terms left cannot lift a part to the `keep`-th
best score so far, no new part is taken up: what is left is only looked up for the parts that may still reach that
score, and a block whose largest gain does not suffice for any of them is not read. What is skipped
cannot be among the best, so the result is exact. Only `keep` rows a question leave each slice of `SLICE` postings
of a partition, which bounds what a task holds.

Questions come in blocks of at most `BLOCK_TERMS` rows of question and term, so that what a task gets of them
has a fixed bound; more questions are more passes over the stored postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings in one block of a list.
BLOCK = 128
#: Rows of question and term that are sent to the tasks at once.
BLOCK_TERMS = 200_000
#: Postings that a task holds at once; parts beyond these are answered by themselves.
SLICE = 250_000
#: Hits of questions and parts that are summed at once.
HITS = 250_000
#: Postings of a list from which it is worth knowing the score to reach first.
WORTH = 512
K1, B = 1.2, 0.75
UNITS = 1e12


@dataclass(frozen=True)
class Asked:
    """A block of questions: `terms[term[first[i]:first[i + 1]]]` are the terms of question i."""

    questions: pa.Array
    first: np.ndarray
    term: np.ndarray
    terms: pa.Array
    idf: np.ndarray
    mean: float


class Lists:
    """The postings of one partition by term; parts are numbered in the order that decides between equal scores."""

    def __init__(self, part: np.ndarray, term: np.ndarray, units: np.ndarray, parts: int, terms: int):
        order = np.lexsort((part, term))
        self.part, self.units = part[order], units[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        sizes = np.diff(self.start)
        blocks = -(-sizes // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        of = np.repeat(np.arange(terms), blocks)
        at = self.start[of] + (np.arange(len(of)) - self.first_block[of]) * BLOCK
        self.block_part = self.part[at] if len(at) else self.part
        self.block_most = np.maximum.reduceat(self.units, at) if len(at) else self.units
        # The largest gain of a whole list is that of its blocks.
        self.most = np.zeros(terms, np.int64)
        some = np.flatnonzero(blocks)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.block_most, self.first_block[some])
        self.score = np.zeros(parts, np.int64)

    def best(self, terms: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(parts, scores, postings read): the `keep` best parts of a question, best first."""
        score, start = self.score, self.start
        terms = terms[start[terms] < start[terms + 1]]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        read, reach, taken, i = 0, 0, [], 0
        while i < len(terms) and rest[i] >= reach:
            span = slice(start[terms[i]], start[terms[i] + 1])
            score[self.part[span]] += self.units[span]
            taken.append(self.part[span])
            read += span.stop - span.start
            i += 1
            if i < len(terms) and start[terms[i] + 1] - start[terms[i]] >= WORTH and sum(map(len, taken)) >= keep <= len(score):
                reach = max(reach, int(np.partition(score, len(score) - keep)[len(score) - keep]))
        found = np.flatnonzero(score)
        for j in range(i, len(terms)):
            found = found[score[found] + rest[j] >= reach]
            low, high = self.first_block[terms[j]], self.first_block[terms[j] + 1]
            block = low + np.searchsorted(self.block_part[low:high], found, "right") - 1
            inside = block >= low
            gain = np.where(inside, self.block_most[np.maximum(block, low)], 0)
            able = score[found] + gain + rest[j + 1] >= reach
            found, block, inside = found[able], block[able], inside[able]
            wanted, span = found[inside], slice(start[terms[j]], start[terms[j] + 1])
            at = np.searchsorted(self.part[span], wanted)
            hit = at < span.stop - span.start
            hit[hit] = self.part[span][at[hit]] == wanted[hit]
            score[wanted[hit]] += self.units[span][at[hit]]
            read += min(BLOCK * len(np.unique(block[inside])), span.stop - span.start)
            if len(found) > keep:
                reach = max(reach, int(np.partition(score[found], len(found) - keep)[len(found) - keep]))
        scores = score[found]
        if len(found) > keep:
            least = np.partition(scores, len(found) - keep)[len(found) - keep]
            found, scores = found[scores >= least], scores[scores >= least]
        order = np.lexsort((found, -scores))[:keep]
        found, scores = found[order], scores[order]
        for part in taken:
            score[part] = 0
        return found, scores, read


def gains(idf: np.ndarray, weight: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What postings add to a score, in units of 1e-12; the operations in the order of `lexical.posting_units`."""
    weight = weight.astype(np.float64)
    gain = idf * (weight * (K1 + 1)) / (weight + K1 * ((1 - B) + B * length / mean))
    return np.floor(gain * UNITS + 0.5).astype(np.int64)


def numbered_parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's part in the order of path, document and part; a row of each part)."""
    order = pc.sort_indices(table, [("source_path", "ascending"), ("document_id", "ascending"), ("part_no", "ascending")]).to_numpy()
    ids, numbers = table["document_id"].to_numpy()[order], table["part_no"].to_numpy()[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (ids[1:] != ids[:-1]) | (numbers[1:] != numbers[:-1])
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(opens) - 1
    return part, order[opens]


def _answered(asked: Asked, keep: int, names: list[str], lists: Lists, table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the best parts, some questions at a time; `read` and `all` are on a question's first row."""
    size = np.diff(lists.start)
    for low in range(0, len(asked.questions), 256):
        high = min(low + 256, len(asked.questions))
        found = [lists.best(asked.term[asked.first[q] : asked.first[q + 1]], keep) for q in range(low, high)]
        counts = np.array([len(f[0]) for f in found])
        question = asked.questions.take(pa.array(np.repeat(np.arange(low, high), counts)))
        row = pa.array(first[np.concatenate([f[0] for f in found])])
        opens = np.concatenate([np.arange(n) == 0 for n in counts]) if len(counts) else np.zeros(0, bool)
        read = np.repeat([f[2] for f in found], counts) * opens
        every = np.repeat([size[asked.term[asked.first[q] : asked.first[q + 1]]].sum() for q in range(low, high)], counts) * opens
        columns = [question, *[table[c].take(row).combine_chunks() for c in names], pa.array(np.concatenate([f[1] for f in found]))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(read), pa.array(every)], ["question_id", *names, "units", "read", "every"])


def _postings_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Whole parts of some `most` postings at a time; the rows of a part follow one another."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(held)
            ids, numbers = table["document_id"].to_numpy(), table["part_no"].to_numpy()
            other = np.flatnonzero((ids != ids[-1]) | (numbers != numbers[-1]))
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield table.slice(0, end)
            held, size = table.slice(end).to_batches(), table.num_rows - end
    if size:
        yield pa.Table.from_batches(held)


def _parts_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of parts, with some `most` postings in all at a time, or one part."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("found")).to_numpy(zero_copy_only=False))
        begin, before = 0, 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, before + most - size, "right"))
            end = max(end, begin + (not held))
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size, before, begin = size + int(ends[end - 1]) - before, int(ends[end - 1]), end
            if begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _from_postings(asked: Asked, keep: int, names: list[str]) -> Callable:
    """Rows are postings; those of a part are in one partition and follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _postings_slices((b for b in batches if b.num_rows), SLICE):
            term = pc.index_in(table["term"], value_set=asked.terms).combine_chunks()
            table, term = table.filter(term.is_valid()), term.drop_null().to_numpy().astype(np.int64)
            part, first = numbered_parts(table)
            units = gains(asked.idf[term], table["weight"].to_numpy(), table["length"].to_numpy(), asked.mean)
            yield from _answered(asked, keep, names, Lists(part, term, units, len(first), len(asked.terms)), table, first)

    return run


def _weighed_terms(asked: Asked, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, units) of each posting of rows of parts."""
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(table["found"]).to_numpy())
    term, weight = (pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("found", "weights"))
    return row, term, gains(asked.idf[term], weight, table["length"].to_numpy()[row], asked.mean)


def _from_parts(asked: Asked, keep: int, names: list[str]) -> Callable:
    """Rows are parts with the numbers of their asked terms (`found`) and the weights of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts_slices((b for b in batches if b.num_rows), SLICE):
            part, first = numbered_parts(table)
            row, term, units = _weighed_terms(asked, table)
            yield from _answered(asked, keep, names, Lists(part[row], term, units, len(first), len(asked.terms)), table, first)

    return run


def _all_of_parts(asked: Asked, names: list[str]) -> Callable:
    """Every question that a part has a term of, with its score; rows as in `_from_parts`."""
    order = np.argsort(asked.term, kind="stable")
    question = np.repeat(np.arange(len(asked.questions)), np.diff(asked.first))[order]
    start = np.searchsorted(asked.term[order], np.arange(len(asked.terms) + 1))
    asking = np.diff(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts_slices((b for b in batches if b.num_rows), SLICE):
            row, term, units = _weighed_terms(asked, table)
            hits = np.concatenate([[0], np.cumsum(asking[term])])
            # Postings of whole parts, with some HITS in all at a time.
            edges = np.searchsorted(row, np.arange(table.num_rows + 1))
            low = 0
            while low < table.num_rows:
                high = max(low + 1, int(np.searchsorted(hits[edges], hits[edges[low]] + HITS, "right")) - 1)
                span = slice(edges[low], edges[high])
                times = asking[term[span]]
                at = np.repeat(start[term[span]] - (hits[span] - hits[span.start]), times) + np.arange(times.sum())
                key, place = np.unique(np.repeat(row[span], times) * len(asked.questions) + question[at], return_inverse=True)
                sums = np.zeros(len(key), np.int64)
                np.add.at(sums, place, np.repeat(units[span], times))
                of, which = np.divmod(key, len(asked.questions))
                for cut in range(0, len(key), 100_000):
                    here = slice(cut, cut + 100_000)
                    columns = [table[c].take(pa.array(of[here])).combine_chunks() for c in names]
                    yield pa.RecordBatch.from_arrays([asked.questions.take(pa.array(which[here])), *columns, pa.array(sums[here])], ["question_id", *names, "units"])
                low = high

    return run


def asked_blocks(terms: DataFrame, weighed: Callable[[DataFrame], tuple[DataFrame, float | None]], limit: int = BLOCK_TERMS) -> Iterator[Asked]:
    """The questions in blocks by hash of their id. `terms` has question_id and term; `weighed` gives terms their idf,
    and the mean part length."""
    blocks = max(1, -(-terms.count() // limit))
    for block in range(blocks):
        mine = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        known, mean = weighed(mine)
        rows = known.select("question_id", "term", "idf").toArrow()
        if rows.num_rows:
            yield asked_of(rows, mean)


def asked_of(rows: pa.Table, mean: float) -> Asked:
    """A block from its rows (question_id, term, idf)."""
    rows = rows.sort_by([("question_id", "ascending"), ("term", "ascending")])
    questions = rows["question_id"].combine_chunks().dictionary_encode()
    terms = rows["term"].combine_chunks().dictionary_encode()
    number, term = questions.indices.to_numpy(), terms.indices.to_numpy().astype(np.int64)
    idf = np.zeros(len(terms.dictionary))
    idf[term] = rows["idf"].to_numpy()
    return Asked(questions.dictionary, np.searchsorted(number, np.arange(len(questions.dictionary) + 1)), term, terms.dictionary, idf, mean)


def best_rows(frame: DataFrame, asked: Asked, question_type: str, keep: int, names: list[str], of_parts: bool) -> DataFrame:
    """The rows that leave each partition: question_id, `names` of the part, units, read, every."""
    kinds = dict(frame.dtypes)
    schema = f"question_id {question_type}, " + ", ".join(f"{c} {kinds[c]}" for c in names) + ", units long, read long, every long"
    if not of_parts:
        frame = frame.sortWithinPartitions("document_id", "part_no")
    return frame.mapInArrow((_from_parts if of_parts else _from_postings)(asked, keep, names), schema)


def all_scores(parts: DataFrame, asked: Asked, question_type: str, names: list[str]) -> DataFrame:
    """question_id, `names` of the part and units for every question and part that share a term; nothing is moved."""
    kinds = dict(parts.dtypes)
    schema = f"question_id {question_type}, " + ", ".join(f"{c} {kinds[c]}" for c in names) + ", units long"
    return parts.mapInArrow(_all_of_parts(asked, names), schema)
