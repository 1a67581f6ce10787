"""Small brute-force counterparts of the operators."""

from __future__ import annotations

from collections import Counter, defaultdict, deque


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def class_table(gold, pred, classes):
    """{class: (precision, recall, f1, support)}, zero where a denominator is zero."""
    out = {}
    for c in classes:
        tp = sum(g == c and p == c for g, p in zip(gold, pred))
        predicted, support = sum(p == c for p in pred), sum(g == c for g in gold)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        total = precision + recall
        out[c] = (precision, recall, 2 * precision * recall / total if total else 0.0, support)
    return out


def kfold_sizes(labels, k):
    """Class sizes per fold when rows in class order are dealt to the folds in turn."""
    dealt = Counter()
    for i, label in enumerate(sorted(labels)):
        dealt[(label, i % k + 1)] += 1
    return dealt


def walk(comments):
    """Queue walk over (id, parent or None, seq): [(id, depth)] in breadth-first order."""
    children = defaultdict(list)
    for cid, parent, seq in sorted(comments, key=lambda c: c[2]):
        children[parent].append(cid)
    queue, out = deque((c, 0) for c in children[None]), []
    while queue:
        cid, depth = queue.popleft()
        out.append((cid, depth))
        queue.extend((c, depth + 1) for c in children[cid])
    return out
