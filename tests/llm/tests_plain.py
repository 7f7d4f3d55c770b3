"""Plain versions of operators that several tests compare with."""

from quillspark.llm import lines


def plain_targets(sizes):
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total, out, free = sum(sizes.values()), {}, set(sources)
    while free:
        share = (total - sum(out.values())) / sum(weights[s] for s in free)
        over = {s for s in free if share * weights[s] >= 3 * sizes[s]}
        if not over:
            return out | {s: share * weights[s] for s in free}
        out |= {s: 3 * sizes[s] for s in over}
        free -= over
    return out


def plain_drops(rows):
    """Line numbers to drop by document: groups by comparing with every founder, counts by plain sets."""
    import numpy as np

    held, sizes, docs_of = [], {}, {}
    for doc, text in rows:
        known = set()
        for n, k in enumerate(lines.line_keys(text)):
            if k is not None:
                held.append((doc, n, k, k not in known))
                known.add(k)
        sizes[doc] = sum(len(sig) // 2 for _, sig in known)
        for k in known:
            docs_of.setdefault(k, set()).add(doc)
    fixed = {k: int((np.frombuffer(k[1], np.uint16) != lines._MASKED).sum()) for k in docs_of}

    def needs(n_fixed, which):
        return next(step[which] for step in lines.EVIDENCE if n_fixed >= step[0])

    template = {}
    for leaf in {k[0] for k in docs_of}:
        own = [k for k in docs_of if k[0] == leaf]
        if sum(len(docs_of[k]) for k in own) < needs(max(fixed[k] for k in own), 1):
            continue
        founders = []
        for k in sorted(own, key=lambda k: (-len(docs_of[k]), k[1])):
            tokens = np.frombuffer(k[1], np.uint16)
            found = next((f for f in founders if (np.frombuffer(f[1], np.uint16) == tokens).sum() >= 0.8 * len(tokens) - 1e-9), None)
            if found is None:
                founders.append(k)
            template[k] = found or k
    held = [(doc, n, k, fresh) for doc, n, k, fresh in held if k in template]
    origin = {}
    for doc, _, k, _ in held:
        origin[template[k]] = min(doc, origin.get(template[k], doc))
    shared = {}
    for doc, _, k, fresh in held:
        o = origin[template[k]]
        if fresh and o != doc:
            shared[doc, o] = shared.get((doc, o), 0) + len(k[1]) // 2
    group = {doc: o for (doc, o), n in shared.items() if n >= 0.8 * max(sizes[doc], sizes[o]) - 1e-6}
    drops = {}
    for t in set(template.values()):
        mine = [(doc, n, k, fresh) for doc, n, k, fresh in held if template[k] == t]
        least = min(fixed[k] for _, _, k, _ in mine)
        if sum(fresh for *_, fresh in mine) < needs(least, 1) or len({group.get(doc, doc) for doc, *_ in mine}) < needs(least, 2):
            continue
        first = min(doc for doc, *_ in mine)
        home = group.get(first, first)
        for doc, n, *_ in mine:
            if group.get(doc, doc) != home:
                drops.setdefault(doc, set()).add(n)
    return drops
