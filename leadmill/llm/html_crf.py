"""A linear-chain conditional random field over leaf blocks: article text or everything else.

A block's features are its ancestors' tags and names and the look of its text. Training maximises
the conditional likelihood of labelled pages (forward-backward, Adam); decoding is Viterbi's.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from leadmill.llm.html_blocks import Block

_ODD = re.compile(r"[©|»«›‹→←]")
_WORDS = frozenset("advertisement advert sponsored cookie cookies subscribe newsletter login register copyright rights reserved privacy terms menu share comment comments reply related read more previous next search home contact follow posted accept sign".split())


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {f"in {element.split(' ', 1)[0]}" for element in path}
    for element in path:
        out |= {f"named {word}" for word in element.split(" ")[1:]}
    if path:
        tag, *names = path[-1].split(" ")
        out.add(f"own {tag}")
        out |= {f"own named {word}" for word in names}
        out.add(f"own {tag} of {path[-2].split(' ', 1)[0] if len(path) > 1 else 'none'}")
    return sorted(out)


def text_features(block: Block, at: int, of: int) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [f"words {min(7, n.bit_length())}", f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"links {share >= 0.5} words {min(4, n.bit_length())}"]
    out.append(f"ends {'.' if text[-1] in '.!?…:;\"”' else 'other'}")
    if _ODD.search(text):
        out.append("sign")
    if n < 12:
        out += [f"says {w}" for w in set(text.lower().replace(".", " ").replace(":", " ").split()) & _WORDS]
    if at == 0:
        out.append("first")
    if at == of - 1:
        out.append("last")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    return [path_features(b.path) + text_features(b, i, len(blocks)) for i, b in enumerate(blocks)]


class Model(NamedTuple):
    weights: dict[str, float]  # of article against the rest
    moves: list[list[float]]  # moves[a][b]: from label a to b
    start: list[float]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, ridge: float = 1e-3) -> Model:
    """Fits a model to pages of (blocks, labels); label 1 is article text."""
    pages = [p for p in pages if p[0]]
    named = [features(blocks) for blocks, _ in pages]
    number = {f: i for i, f in enumerate(sorted({f for page in named for block in page for f in block}))}
    longest = max(len(p) for p in named)
    flat, block_of = [], []
    gold = np.zeros((len(pages), longest), dtype=np.int64)
    real = np.zeros((len(pages), longest), dtype=bool)
    for p, (page, (_, labels)) in enumerate(zip(named, pages, strict=True)):
        gold[p, : len(labels)], real[p, : len(labels)] = labels, True
        for i, block in enumerate(page):
            flat += [number[f] for f in block]
            block_of += [p * longest + i] * len(block)
    flat_, block_ = np.array(flat), np.array(block_of)
    lengths = real.sum(axis=1)
    theta = np.zeros(len(number) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((len(pages), longest, 2))
        score[:, :, 1] = np.bincount(block_, w[flat_], minlength=real.size).reshape(real.shape)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            ahead[:, t] = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1)
        for t in range(longest - 2, -1, -1):
            step_back = np.logaddexp.reduce(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where((t + 1 < lengths)[:, None], step_back, 0)
        rows = np.arange(len(pages))
        z = np.logaddexp.reduce(ahead[rows, lengths - 1], axis=1)
        chance = np.exp(ahead + back - z[:, None, None]) * real[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        gradient = np.zeros_like(theta)
        gradient[:-6] = np.bincount(flat_, (gold * real - chance[:, :, 1]).ravel()[block_], minlength=len(number))
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        gradient[-6:-2] = (seen - pair.sum(axis=(0, 1))).ravel()
        gradient[-2:] = np.bincount(gold[:, 0], minlength=2) - chance[:, 0].sum(axis=0)
        gradient = gradient / len(pages) - ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in number.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def decode(blocks: list[Block], model: Model, memo: dict[tuple[str, ...], float]) -> list[int]:
    """The most likely labels of a page's blocks."""
    if not blocks:
        return []
    weights, ((m00, m01), (m10, m11)) = model.weights, model.moves
    back: list[tuple[int, int]] = []
    zero = one = 0.0
    for i, block in enumerate(blocks):
        own = memo.get(block.path)
        if own is None:
            own = memo[block.path] = sum(weights.get(f, 0.0) for f in path_features(block.path))
        own += sum(weights.get(f, 0.0) for f in text_features(block, i, len(blocks)))
        if i == 0:
            zero, one = model.start[0], model.start[1] + own
            continue
        to_zero, to_one = (0, zero + m00) if zero + m00 >= one + m10 else (1, one + m10), (0, zero + m01) if zero + m01 >= one + m11 else (1, one + m11)
        back.append((to_zero[0], to_one[0]))
        zero, one = to_zero[1], to_one[1] + own
    labels = [int(one > zero)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]
