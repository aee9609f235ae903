"""Language-model scoring: a gated recurrent network in numpy with class-factored output.

Counts of all training tokens give the vocabulary, the classes and the scores of rare words. The network
is trained by truncated backpropagation through time on all training tokens, dealt to trainers whose number
grows with the table and whose weights are averaged. Scoring carries the state across windows, so that the
score is the log-likelihood of the complete document.
"""

from __future__ import annotations

import heapq
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barlake.llm.common import arrow_pass, most_frequent, ship_library, stored

CLASSES, PER_CLASS, HIDDEN = 64, 64, 32
# Numbers of the two tokens that are no words; words follow, most frequent first.
END, RARE = 0, 1
BLOCK = 8192
# Tokens as they are stored; there are at most CLASSES * PER_CLASS of them.
TOKEN = np.dtype("<u2")
# Networks that are added up in one go.
FAN_IN = 64
# Lanes and rate of the trainers: wide steps, so that a pass over all tokens is affordable.
LANES, RATE = 256, 0.01
# Rows of logits worked on in one go, so that they stay in the cache; tokens of a range when gradients of the most
# frequent ones are added up; windows whose tokens are laid out in one go.
ROWS, NARROW, SPAN = 1024, 8, 16
# Numbers that a step of the network works on, a token, over HIDDEN.
ROOM = 8
# A bias further below the largest of its class counts as this: its exponential is no zero in single precision.
LEAST_BIAS = -80
# Rows whose words are looked up in one go, as each time the vocabulary is hashed.
LOOKED_UP_ROWS = 4_000
# Rows scored in one go: a long text among few leaves most lanes idle. Spark bounds the bytes of a batch.
SCORED_ROWS = 10_000


def words_of_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with A-Z in lower case, one text behind the other, and their number in each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, lengths = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at an end of a text has an empty word beyond it.
    some = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(some, min_count=0).as_py():
        owner = np.repeat(np.arange(len(lengths)), lengths)
        holes = np.flatnonzero(~some.to_numpy(zero_copy_only=False))
        lengths -= np.bincount(owner[holes], minlength=len(lengths))
        words = words.filter(some)
    return words, lengths


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """Occurrences of each word over all rows: word, n. Tasks add up the words of a batch first."""
    def make():
        def work(batch: pa.RecordBatch):
            words, _ = words_of_rows(batch.column(0))
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])
        return work

    slim = docs.select(F.coalesce(text, F.lit("")).alias("__text"))
    return (arrow_pass(slim, "word string, n bigint", make, rows=20_000)
            .groupBy("word").agg(F.sum("n").alias("n")))


def planes_of(rows: np.ndarray) -> np.ndarray:
    """What rows hold for update, reset and fresh state, one after the other."""
    return rows.reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy()


def shares_of(states: np.ndarray, weights: np.ndarray, biases: np.ndarray, masses: np.ndarray, places: np.ndarray,
              edges: list[int], bounded: bool, gradient=False):
    """Log share of each row's place among those of its class; the rows of class c are those from edges[c] to
    edges[c + 1]. `masses` are the exponentials of the biases.

    With `gradient`, also the gradients of the mean loss for the states, and for weights and biases; these are
    put into `gradient` if it is a pair of zeros. Rows are taken in blocks that stay in the cache.
    """
    n, kinds = len(states), weights.shape[2]
    dtype = np.result_type(states, weights)
    result, room, sums = np.empty(n, dtype), np.empty((ROWS, kinds), dtype), np.empty(ROWS, dtype)
    if not bounded:
        masses = np.ones_like(masses)
    starts, one = np.arange(ROWS) * kinds, np.ones(ROWS, dtype)
    owner = np.repeat(np.arange(len(weights)), np.diff(edges))
    if gradient:
        hits = (1 / (n * masses))[owner, places]
        own = gradient if isinstance(gradient, tuple) else (np.zeros_like(weights), np.zeros_like(biases))
        back, through = np.empty((n, states.shape[1]), dtype), (weights * masses[:, None]).transpose(0, 2, 1)
    c = 0
    for low in range(0, n, ROWS):
        high = min(low + ROWS, n)
        pieces = []
        while edges[c] < high:
            first, last = max(edges[c], low), min(edges[c + 1], high)
            if first < last:
                pieces.append((c, slice(first, last), slice(first - low, last - low)))
            if edges[c + 1] > high or c + 2 == len(edges):
                break
            c += 1
        logits, total = room[:high - low], sums[:high - low]
        for k, rows, here in pieces:
            np.matmul(states[rows], weights[k], out=logits[here])
            if not bounded:
                logits[here] += biases[k]
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        at = starts[:high - low] + places[low:high]
        flat = logits.reshape(-1)
        np.take(flat, at, out=result[low:high], mode="clip")
        np.exp(logits, out=logits)
        for k, _, here in pieces:
            np.matmul(logits[here], masses[k], out=total[here])
        result[low:high] -= np.log(total)
        if gradient:
            logits *= (1 / (n * total))[:, None]
            flat[at] -= hits[low:high]
            for k, rows, here in pieces:
                np.matmul(logits[here], through[k], out=back[rows])
                if rows.start == edges[k]:
                    np.matmul(states[rows].T, logits[here], out=own[0][k])
                else:
                    own[0][k] += states[rows].T @ logits[here]
                own[1][k] += one[here] @ logits[here]
    if bounded:
        result += biases[owner, places]
    if not gradient:
        return result, None, None
    own[0][...] *= masses[:, None]
    own[1][...] *= masses
    return result, back, own


class Gru:
    """Weights of the network; `inputs` holds each token's projected embedding with the biases."""

    NAMES = ("inputs", "recurrent", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, token_counts: np.ndarray, seed: int = 5):
        draw = np.random.default_rng(seed)
        size = len(token_counts)
        self.classes = -(-size // PER_CLASS)
        self.inputs = draw.normal(0, 0.1, (size, 3 * HIDDEN)).astype(np.float32)
        self.recurrent = draw.normal(0, 0.15, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.to_class = draw.normal(0, 0.05, (HIDDEN, self.classes)).astype(np.float32)
        self.to_word = draw.normal(0, 0.05, (self.classes, HIDDEN, PER_CLASS)).astype(np.float32)
        # Untrained, the network gives every token its share of all tokens.
        mass = np.full(self.classes * PER_CLASS, 1e-30)
        mass[:size] = token_counts + 0.5
        mass = mass.reshape(self.classes, PER_CLASS)
        self.class_bias = np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
        self.word_bias = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def view(self, flat: np.ndarray) -> Gru:
        """Take the weights from a flat array, which they stay parts of."""
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at:at + old.size].reshape(old.shape))
            at += old.size
        return self

    def load(self, flat: np.ndarray) -> Gru:
        return self.view(flat.astype(np.float32))

    def sums_of_tokens(self, tokens: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Sums of the rows of each token, rows in order of their tokens: range by range, a product with the
        tokens' indicators. Ranges of the most frequent tokens, which have most rows, are narrow."""
        size = len(self.inputs)
        result = np.zeros((size, rows.shape[1]), np.float32) if out is None else out
        for low, high, width in ((0, PER_CLASS, NARROW), (PER_CLASS, self.classes * PER_CLASS, PER_CLASS)):
            edges = np.searchsorted(tokens, np.arange(low, high + 1, width))
            first, last = edges[0], edges[-1]
            marks = np.zeros((last - first, width), np.float32)
            marks[np.arange(last - first), tokens[first:last] % width] = 1
            edges = edges.tolist()
            for k in range(len(edges) - 1):
                own, at = slice(edges[k], edges[k + 1]), low + k * width
                if own.start < own.stop:
                    some = result[at:at + width]
                    np.matmul(marks[own.start - first:own.stop - first, :len(some)].T, rows[own], out=some)
        return result

    def step(self, state: np.ndarray, tokens: np.ndarray, planes: np.ndarray, room: np.ndarray, after: np.ndarray,
             flows: np.ndarray | None = None, keeps: np.ndarray | None = None) -> None:
        """The next state, put into `after`; it is zero behind an end. `planes` are the recurrent weights for
        update, reset and fresh state one after the other, `room` has ROOM rows of HIDDEN numbers a token to work in.

        `flows` takes what a flow back into the next state is multiplied with: for the fresh state, update and
        reset as they are carried, and for the fresh state as it is given; `keeps` the same for the state.
        """
        n = len(tokens)
        given, carried = room[:3 * n].reshape(n, 3, HIDDEN), room[3 * n:6 * n].reshape(3, n, HIDDEN)
        spare, fresh = room[6 * n:7 * n], room[7 * n:8 * n]
        np.take(self.inputs, tokens, axis=0, out=given.reshape(n, -1), mode="clip")
        np.matmul(state, planes, out=carried)
        # What the gates shut out, 1 less the gates.
        shut = carried[:2]
        shut += given.transpose(1, 0, 2)[:2]
        np.exp(shut, out=shut)
        shut += 1
        np.reciprocal(shut, out=shut)
        no_update, no_reset, recalled = carried
        np.multiply(no_reset, recalled, out=spare)
        recalled -= spare
        np.add(recalled, given[:, 2], out=fresh)
        np.tanh(fresh, out=fresh)
        np.subtract(state, fresh, out=spare)
        spare *= no_update
        np.subtract(state, spare, out=after)
        ends = (tokens == END).nonzero()[0]
        after[ends] = 0
        if flows is not None:
            np.subtract(1, no_update, out=keeps)
            np.multiply(spare, keeps, out=flows[:, 1])
            fresh *= fresh
            np.subtract(1, fresh, out=fresh)
            fresh *= no_update
            flows[:, 3] = fresh
            recalled *= no_reset
            np.multiply(fresh, recalled, out=flows[:, 2])
            np.subtract(1, no_reset, out=spare)
            np.multiply(fresh, spare, out=flows[:, 0])
            flows[ends] = 0
            keeps[ends] = 0

    def masses(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
        """Biases of classes and of words, less the largest of their class, and their exponentials, none of
        which vanishes; whether logits without their biases are so small that their exponentials neither
        overflow nor vanish, as states lie within -1 and 1."""
        widest = max(np.abs(self.to_class).sum(axis=0).max(), np.abs(self.to_word).sum(axis=1).max())
        biases = [np.maximum(bias - bias.max(axis=1, keepdims=True), LEAST_BIAS)
                  for bias in (self.class_bias[None], self.word_bias)]
        return [(bias, np.exp(bias)) for bias in biases], bool(widest < 30)

    def log_shares(self, states: np.ndarray, tokens: np.ndarray, gradient: bool = False, masses=None,
                   order: np.ndarray | None = None, grads: dict[str, np.ndarray] | None = None):
        """Natural log probability of each token given the state before it, by class, then in its class.

        With `gradient`, also the gradients of the mean loss for the states and, put into `grads` if given,
        for the output weights. `masses` are those of `masses`, if the weights have not changed since; `order`
        sorts the tokens by their classes.
        """
        n = len(tokens)
        classes = tokens // PER_CLASS
        places = tokens - classes * PER_CLASS
        of_levels, bounded = masses or self.masses()
        # Rows in order of their classes, so that each class has its rows side by side.
        if order is None:
            order = np.argsort(classes.astype(np.uint8 if self.classes <= 256 else np.int64), kind="stable")
        edges = np.searchsorted(classes[order], np.arange(self.classes + 1)).tolist()
        sorted_states, sorted_places = np.take(states, order, axis=0), places[order]
        result, back, own = shares_of(sorted_states, self.to_word, *of_levels[1], sorted_places, edges, bounded,
                                      gradient and (grads["to_word"], grads["word_bias"]) if grads else gradient)
        back_places = np.empty_like(order)
        back_places[order] = np.arange(n)
        result = np.take(result, back_places)
        more, more_back, own_class = shares_of(
            states, self.to_class[None], *of_levels[0], classes, [0, n], bounded,
            gradient and (grads["to_class"][None], grads["class_bias"][None]) if grads else gradient)
        result += more
        if not gradient:
            return result
        more_back += np.take(back, back_places, axis=0)
        return result, more_back, {"to_class": own_class[0][0], "class_bias": own_class[1][0],
                                   "to_word": own[0], "word_bias": own[1]}

    def train(self, stream: np.ndarray, lanes: int = 32, window: int = 32, rate: float = 0.004) -> Gru:
        """One pass of truncated backpropagation over a stream of tokens, cut into parallel lanes.

        States are carried from window to window; gradients stop at its beginning. Adam updates.
        """
        if not len(stream):
            return self
        lanes = max(1, min(lanes, len(stream) // window))
        length = -(-len(stream) // lanes)
        # No token is left over: the last lane is filled up from the beginning of the stream.
        ids = np.resize(stream, lanes * length).reshape(lanes, length).T
        weights = self.flat()
        self.view(weights)
        adam = Adam(weights, rate)
        gradient = np.empty_like(weights)
        grads = vars(copy(self).view(gradient))
        room = np.empty((ROOM * lanes, HIDDEN), np.float32)
        all_states = np.zeros((window + 1, lanes, HIDDEN), np.float32)
        all_flows = np.empty((window, lanes, 4, HIDDEN), np.float32)
        keeps = np.empty((window, lanes, HIDDEN), np.float32)
        for turn, start in enumerate(range(0, length, window), 1):
            part = np.ascontiguousarray(ids[start:start + window])
            steps, planes, flows = len(part), planes_of(self.recurrent), all_flows[:len(part)]
            for t in range(steps):
                self.step(all_states[t], part[t], planes, room, all_states[t + 1], flows[t], keeps[t])
            states, flat = all_states[:steps].reshape(-1, HIDDEN), part.ravel()
            order = np.argsort(flat.astype(TOKEN), kind="stable")
            gradient.fill(0)
            _, back, _ = self.log_shares(states, flat, gradient=True, order=order, grads=grads)
            back = back.reshape(steps, lanes, HIDDEN)
            through = np.roll(self.recurrent, HIDDEN, axis=1).T.copy()
            later, sent = np.zeros((2, lanes, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                flows[t] *= later[:, None]
                later *= keeps[t]
                later += back[t]
                later += np.matmul(flows[t].reshape(lanes, -1)[:, :3 * HIDDEN], through, out=sent)
            sent_back = flows.reshape(len(flat), -1)
            grads["recurrent"][...] = np.roll(states.T @ sent_back[:, :3 * HIDDEN], -HIDDEN, axis=1)
            self.sums_of_tokens(flat[order], np.take(sent_back, order, axis=0)[:, HIDDEN:], grads["inputs"])
            all_states[0] = all_states[steps]
            adam.step(gradient, turn)
        return self

    def score(self, documents: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each whole document (tokens up to and including its end).

        Documents are laid one behind the other into lanes of about equal length; the state is carried
        through each document, whatever its length, and starts anew behind its end.
        """
        result = np.zeros(len(documents))
        if not documents:
            return result
        lanes = min(lanes, len(documents))
        loads = [(0, lane) for lane in range(lanes)]
        laid: list[list[int]] = [[] for _ in range(lanes)]
        for number in sorted(range(len(documents)), key=lambda k: -len(documents[k])):
            load, lane = heapq.heappop(loads)
            laid[lane].append(number)
            heapq.heappush(loads, (load + len(documents[number]), lane))
        streams = [np.concatenate([documents[k] for k in lane]) for lane in laid]
        owners = [np.repeat(lane, [len(documents[k]) for k in lane]) for lane in laid]
        order = sorted(range(lanes), key=lambda lane: -len(streams[lane]))
        lengths = np.array([len(streams[lane]) for lane in order])
        masses, planes = self.masses(), planes_of(self.recurrent)
        room = np.empty((ROOM * lanes, HIDDEN), np.float32)
        state = np.zeros((lanes, HIDDEN), np.float32)
        # Lanes are sorted by length, so those that still have tokens at a step are the first ones.
        # Few busy lanes get longer windows, so that a window always holds about as many tokens.
        start, longest = 0, int(lengths[0])
        while start < longest:
            busy = int((lengths > start).sum())
            steps = min(window * SPAN * max(1, lanes // busy), longest - start)
            ids, owner = np.zeros((steps, busy), np.int32), np.zeros((steps, busy), np.int64)
            for column in range(busy):
                part = streams[order[column]][start:start + steps]
                ids[:len(part), column] = part
                owner[:len(part), column] = owners[order[column]][start:start + steps]
            active = np.searchsorted(-lengths, -np.arange(start, start + steps)).tolist()
            at = 0
            while at < steps:
                some = min(window * max(1, lanes // active[at]), steps - at)
                ends = np.cumsum([0, *active[at:at + some]]).tolist()
                states = np.empty((ends[-1] + lanes, HIDDEN), np.float32)
                states[:active[at]] = state[:active[at]]
                for t in range(some):
                    n = active[at + t]
                    after = states[ends[t + 1]:ends[t + 1] + n]
                    self.step(states[ends[t]:ends[t + 1]], ids[at + t, :n], planes, room, after)
                state = after
                tokens, whose = (np.concatenate([x[at + t, :active[at + t]] for t in range(some)])
                                 for x in (ids, owner))
                shares = self.log_shares(states[:ends[-1]], tokens, masses=masses)
                result += np.bincount(whose, shares, len(documents))
                at += some
            start += steps
        return result


class Adam:
    """Adam on one flat array of weights, in place and piece by piece, so that a piece stays in the cache.

    The moments are kept without the factors 0.1 and 0.01, which are put into the step.
    """

    PIECE = 1 << 14

    def __init__(self, weights: np.ndarray, rate: float):
        self.rate, self.size = rate, len(weights)
        self.weights, self.room = weights, np.empty(self.PIECE, np.float32)
        self.first, self.second = np.zeros((2, len(weights)), np.float32)

    def step(self, gradient: np.ndarray, turn: int) -> None:
        """Gradients longer than 1 are cut to that length."""
        length = np.sqrt(float(gradient @ gradient)) + 1e-12
        if length > 1:
            gradient *= np.float32(1 / length)
        unit = np.sqrt(0.01 / (1 - 0.99 ** turn))
        rate = np.float32(0.1 * self.rate / (1 - 0.9 ** turn) / unit)
        least, slow, fast = np.float32(1e-7 / unit), np.float32(0.99), np.float32(0.9)
        for start in range(0, self.size, self.PIECE):
            own = slice(start, start + self.PIECE)
            g, first, second = gradient[own], self.first[own], self.second[own]
            room, weights = self.room[:len(g)], self.weights[own]
            first *= fast
            first += g
            g *= g
            second *= slow
            second += g
            np.sqrt(second, out=room)
            room += least
            np.divide(first, room, out=room)
            room *= rate
            weights -= room


class Vocabulary:
    """Frequent words with their counts; the first of them are tokens of the network."""

    def __init__(self, words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.words = [words[k] for k in order]
        self.counts = np.array([counts[k] for k in order], np.int64)
        self.tokens = min(len(words), CLASSES * PER_CLASS - 2)  # words that are tokens of their own
        self.place = {word: k for k, word in enumerate(self.words)}


def fit(training: DataFrame, text: str, head_words: int = 150_000):
    """Counts (a frame of word and n), totals and the vocabulary, all of them over all training rows.

    `head_words` bounds what is sent to every task: the words with the highest counts; rarer words are
    looked up by a join.
    """
    counts = stored(count_tokens(training, text), "lm-counts")
    sums = counts.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    rows = training.count()
    words, spoken = sums["words"], sums["n"] or 0
    head = most_frequent(counts, head_words).collect()
    vocabulary = Vocabulary([r["word"].encode() for r in head], [r["n"] for r in head])
    own = vocabulary.counts[:vocabulary.tokens]
    totals = {"rows": rows, "tokens": spoken + rows, "kinds": words + (rows > 0),
              "rare_tokens": int(spoken - own.sum()), "rare_kinds": words - len(own)}
    return counts, totals, vocabulary


def fit_network(passed: DataFrame, totals: dict[str, int], vocabulary: Vocabulary,
                trainer_tokens: int = 2_000_000, rounds: int = 2, seed: int = 11) -> tuple[Gru, int]:
    """The network, trained on all tokens of the rows of `passed` (id, row, tokens), and their number.

    Every row trains once: rows are dealt to rounds, and in a round to trainers of about `trainer_tokens`
    each, by a hash of id, tokens and place, so that rows that are alike are spread as well. In each round
    all trainers start from the average of the round before, in which every token has the same weight and
    which is taken in steps of at most FAN_IN sums.
    """
    spark = passed.sparkSession
    own = vocabulary.counts[:vocabulary.tokens]
    network = Gru(np.concatenate([[totals["rows"], totals["rare_tokens"]], own]).astype(float))
    size, trainers = len(own) + 2, max(1, -(-totals["tokens"] // (trainer_tokens * rounds)))
    at = F.xxhash64(F.col("id").cast("string"), "tokens", "row")
    dealt = passed.select("tokens", at.alias("at"))
    trained_tokens = 0
    for turn in range(rounds if totals["rows"] else 0):
        shared = spark.sparkContext.broadcast(network.flat())

        def trained(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["at", "tokens"])
            stream = np.frombuffer(b"".join(frame["tokens"]), TOKEN).astype(np.int32)
            network = Gru(np.ones(size)).load(shared.value).train(stream, LANES, rate=RATE)
            flat = network.flat() * np.float32(len(stream))
            blocks = [flat[k:k + BLOCK] for k in range(0, len(flat), BLOCK)]
            return pd.DataFrame({"part": frame["trainer"].iloc[0] // FAN_IN, "block": range(len(blocks)),
                                 "n": len(stream), "weights": blocks})

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            return pd.DataFrame({"part": [first["part"] // FAN_IN], "block": [first["block"]],
                                 "n": [frame["n"].sum()],
                                 "weights": [np.sum(frame["weights"].to_numpy(), axis=0)]})

        kind = "part bigint, block int, n bigint, weights array<float>"
        group = dealt.filter(F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(rounds)) == turn).withColumn(
            "trainer", F.pmod(F.xxhash64("at", F.lit(seed + 1)), F.lit(trainers)))
        blocks, parts = group.groupBy("trainer").applyInPandas(trained, kind), trainers
        while parts > 0:
            blocks = blocks.groupBy("part", "block").applyInPandas(summed, kind)
            parts = -(-parts // FAN_IN) if parts > FAN_IN else 0
        blocks = sorted(blocks.collect(), key=lambda r: r["block"])  # one network
        if blocks:
            network.load(np.concatenate([np.array(r["weights"]) / r["n"] for r in blocks]))
            trained_tokens += blocks[0]["n"]
    return network, trained_tokens


def score_documents(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text",
                    head_words: int = 150_000, **options) -> DataFrame:
    """Log10 probability of every whole text under a unigram model and under the network.

    Both learn from the rows where `held_out` is false. Columns: the id, held_out, n_tokens (words and
    the end), n_known (those that training has), train_tokens, base_score (each token's share with one
    added to its count and one unseen kind) and score. A word that is no token of the network has the
    network's probability of a rare word times its share among rare words, one added as well. A null text
    counts as empty: its only token is the end. Without training rows every share is 1 over the kinds.
    One row per row, repeated rows included; an empty table gives an empty one; other columns are ignored.

    Words beyond the shared vocabulary go through a join with the counts, so no task holds all words. Texts
    are turned into tokens once, in a pass that the network is trained and scores from.
    """
    ship_library(docs.sparkSession)
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("body"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, totals, vocabulary = fit(slim.filter("not held_out"), "body", head_words)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.counts, vocabulary.tokens))
    whole = float(totals["tokens"] + totals["kinds"] + 1)
    rare = float(totals["rare_tokens"] + totals["rare_kinds"] + 1)
    rows = totals["rows"]

    def tokenized():
        frequent, counts, most = shared.value
        frequent, unknown = pa.array(frequent, pa.binary()).cast(pa.string()), len(frequent)
        # By place: the token; the logarithm of the count, of all words and of those that are no tokens.
        tokens = np.full(unknown + 1, RARE, TOKEN)
        tokens[:most] = np.arange(most) + 2
        logs = np.append(np.log10(counts + 1.0), 0)
        split_logs = np.where(np.arange(unknown + 1) < most, 0, logs)

        def work(batch: pa.RecordBatch):
            words, lengths = words_of_rows(batch.column(1))
            places = pc.index_in(words, value_set=frequent).fill_null(unknown).to_numpy()
            # Each text has an end behind its words; it adds nothing to the sums.
            stops = np.cumsum(lengths + 1)
            starts, ends = stops - lengths - 1, stops - 1
            is_word = np.ones(stops[-1] if len(stops) else 0, bool)
            is_word[ends] = False
            stream = np.full(len(is_word), END, TOKEN)
            stream[is_word] = tokens[places]

            def sums(values: np.ndarray) -> pa.Array:
                spread = np.zeros(len(is_word), values.dtype)
                spread[is_word] = values
                return pa.array(np.add.reduceat(spread, starts) if len(starts) else spread)

            tail = places == unknown
            known = pc.add(sums((~tail).astype(np.int64)), int(rows > 0))
            tails = sums(tail.astype(np.int64))
            documents = pa.Array.from_buffers(pa.binary(), len(lengths), [
                None, pa.py_buffer(np.append(0, stops * TOKEN.itemsize).astype(np.int32)), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lengths + 1), known, sums(logs[places]),
                 sums(split_logs[places]), sums((places >= most).astype(np.int64)), documents,
                 pa.ListArray.from_arrays(np.append(0, np.cumsum(tails)).astype(np.int32),
                                          words.filter(pa.array(tail)))],
                ["id", "held_out", "n", "known", "base", "split", "rares", "tokens", "tail"])
        return work

    kind = slim.schema["id"].dataType.simpleString()
    passed = stored(
        arrow_pass(slim, f"id {kind}, held_out boolean, n bigint, known bigint, base double, split double, "
                         "rares bigint, tokens binary, tail array<string>", tokenized, rows=LOOKED_UP_ROWS)
        .withColumn("row", F.monotonically_increasing_id()), "lm-pass")
    network, _ = fit_network(passed.filter("not held_out"), totals, vocabulary, **options)
    network_shared = docs.sparkSession.sparkContext.broadcast(network)

    def scored():
        network = network_shared.value

        def work(batch: pa.RecordBatch):
            documents = [np.frombuffer(x, TOKEN).astype(np.int32) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(network.score(documents) / np.log(10))], [*numbers, "network"])
        return work

    numbers = ["row", "id", "held_out", "n", "known", "base", "split", "rares"]
    numbered = passed.select("tokens", *numbers)
    every = stored(arrow_pass(numbered, StructType([*numbered.schema.fields[1:],
                                                    StructField("network", DoubleType())]), scored,
                              rows=SCORED_ROWS), "lm-scored")
    asked = passed.select("row", F.explode("tail").alias("word"))
    found = asked.join(counts, "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("tail_logs"), F.count("*").alias("tail_known"))
    joined = every.join(found, "row", "left")
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_column), "held_out", F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(totals["tokens"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs + F.log10(F.lit(rows + 1.0)) - F.col("n") * F.log10(F.lit(whole)))
        .alias("base_score"),
        (F.col("network") + F.col("split") + logs - F.col("rares") * F.log10(F.lit(rare)))
        .alias("score"))
