"""Structural index of JSON texts, vectorised over a batch.

All texts of a batch lie in one byte buffer. Bitmaps mark backslashes, quotes, brackets and delimiters; prefix sums over
them give what lies inside strings and the nesting depth; everything else (which value belongs to which container, its key
or place, whether the text is complete JSON) is sorting and searching in arrays. Python sees single values only when they
are handed out.
"""

from __future__ import annotations

import json
import re

import numpy as np

_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
# Token kinds
OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COLON, COMMA, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
for _c, _k in zip(b"{[}]:,", range(6)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class JsonIndex:
    """Values of a batch: ``start``/``end`` byte spans, ``doc``, ``container`` (index of the object or array that holds a
    value, -1 at the top), ``pos`` (place in it), ``kind``; ``root`` and ``valid`` by text."""

    def __init__(self, texts: list[bytes]):
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        # A line feed between texts ends every run of backslashes and every scalar.
        self.buf = b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = b.tobytes()
        first = np.zeros(len(texts), np.int64)
        np.cumsum(lens[:-1] + 1, out=first[1:])
        last = first + lens
        n, at = len(b), np.arange(len(b), dtype=np.int64)
        valid = lens > 0

        def texts_of(p: np.ndarray) -> np.ndarray:
            return np.searchsorted(first, p, "right") - 1

        # Quote bitmap: a quote counts unless an odd run of backslashes stands before it.
        slash = b == 92
        if slash.any():
            before = np.maximum.accumulate(np.where(slash, -1, at))  # last place without backslash
            odd = np.zeros(n, bool)
            odd[1:] = (((at - before) & 1) == 1)[:-1] & slash[:-1]
            quote = (b == 34) & ~odd
            starts = slash & (((at - before) & 1) == 1)  # backslashes that begin an escape
        else:
            quote, starts = b == 34, None
        total = np.cumsum(quote, dtype=np.int64)
        base = np.where(first > 0, total[first - 1], 0)
        count = np.where(lens > 0, total[np.maximum(last - 1, 0)], base) - base
        valid &= (count & 1) == 0
        # Only texts with closed strings go on; elsewhere the parity would be that of another text.
        parity = (total - np.repeat(base, lens + 1)) & 1 == 1
        inside = parity & ~quote  # between the quotes
        bad = inside & (b < 32)
        if starts is not None:
            e = np.flatnonzero(starts & inside)
            follow = b[np.minimum(e + 1, n - 1)]
            wrong = ~_ESCAPE[follow]
            u = np.flatnonzero(follow == 117)
            for k in range(2, 6):
                wrong[u] |= ~_HEX[b[np.minimum(e[u] + k, n - 1)]]
            bad[e[wrong]] = True
        valid[texts_of(np.flatnonzero(bad))] = False

        # Bracket and delimiter bitmaps, then depth by prefix sums.
        outside = ~parity & ~quote
        kind = np.where(outside, _KIND[b], -1)
        scalar = outside & (kind < 0) & ~_SPACE[b]
        begins = scalar.copy()
        begins[1:] &= ~scalar[:-1] | False
        ends = np.flatnonzero(scalar & ~np.append(scalar[1:], False)) + 1
        opening = quote & parity  # the opening quote is inside by the running count
        kind[opening] = STRING
        kind[begins] = SCALAR
        pos = np.flatnonzero(kind >= 0)
        kind = kind[pos].astype(np.int8)
        doc = texts_of(pos)
        delta = np.where(kind <= OPEN_A, 1, np.where(kind <= CLOSE_A, -1, 0))
        run = np.cumsum(delta)
        head = np.searchsorted(pos, first)  # first token of each text
        tail = np.searchsorted(pos, last)
        zero = np.where(head > 0, run[np.maximum(head - 1, 0)], 0) if len(run) else np.zeros(len(texts), np.int64)
        depth = run - zero[doc] if len(run) else run
        level = depth - (kind <= OPEN_A)  # opening and closing bracket lie on the level of their container
        if len(run):
            valid[doc[depth < 0]] = False
            final = np.where(tail > head, depth[np.maximum(tail - 1, 0)], 1)
            valid &= (final == 0) & (tail > head)
        else:
            valid[:] = False
        keep = valid[doc]
        pos, kind, doc, level, depth = pos[keep], kind[keep], doc[keep], level[keep], depth[keep]
        m = len(pos)
        end = pos + 1
        closers = np.flatnonzero(quote & ~parity)
        s = kind == STRING
        end[s] = closers[np.searchsorted(closers, pos[s], "right")] + 1 if len(closers) else end[s]
        s = kind == SCALAR
        end[s] = ends[np.searchsorted(ends, pos[s], "right")] if len(ends) else end[s]

        # Container of each token: the last bracket opened one level above, found level by level.
        holder = np.full(m, -1, np.int64)
        is_open, is_close = kind <= OPEN_A, (kind == CLOSE_O) | (kind == CLOSE_A)
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange((level.max() if m else -1) + 3))
        for lv in range(len(cuts) - 1):
            here = by_level[cuts[lv] : cuts[lv + 1]]
            opened = here[is_open[here]]
            if not len(opened):
                continue
            closed = here[is_close[here]]
            holder[closed] = opened[np.searchsorted(opened, closed) - 1]
            end[holder[closed]] = pos[closed] + 1
            inner = by_level[cuts[lv + 1] : cuts[lv + 2]] if lv + 2 < len(cuts) else closed[:0]
            inner = inner[~is_close[inner]]
            holder[inner] = opened[np.searchsorted(opened, inner) - 1]
        own_closers = np.flatnonzero(is_close)
        valid[doc[own_closers[kind[own_closers] != kind[holder[own_closers]] + 2]]] = False
        # Closing brackets count as the last member of what they close, the members lie one level below.
        order = np.lexsort((np.arange(m), holder, np.where(holder < 0, doc, -1)))
        hk, h = kind[order], holder[order]
        same = np.zeros(m, bool)
        same[1:] = (h[1:] == h[:-1]) & ((h[1:] >= 0) | (doc[order][1:] == doc[order][:-1]))
        prev = np.where(same, np.append(np.int8(-1), hk[:-1]) if m else hk, -1)  # -1: first in its container
        in_object = (h >= 0) & (kind[np.maximum(h, 0)] == OPEN_O) if m else same
        value = (hk <= OPEN_A) | (hk >= STRING)
        close = (hk == CLOSE_O) | (hk == CLOSE_A)
        key = in_object & (hk == STRING) & ((prev == -1) | (prev == COMMA))
        was_key = np.append(False, key[:-1]) & same if m else same
        was_value = same & ((prev <= OPEN_A) | (prev >= STRING)) & ~was_key
        good = np.where(
            in_object,
            np.where(key, True, np.where(hk == COLON, was_key, np.where(value, prev == COLON, np.where(hk == COMMA, was_value, (prev == -1) | was_value)))),
            np.where(h < 0, value & ~same, np.where(value, (prev == -1) | (prev == COMMA), np.where(hk == COMMA, was_value, close & ((prev == -1) | was_value)))),
        )
        valid[doc[order[~good]]] = False
        is_value = value & ~key
        place = np.cumsum(is_value) - 1
        group = np.flatnonzero(~same)
        seen = np.cumsum(is_value) - is_value
        self.pos_in = np.zeros(m, np.int64)
        if m:
            self.pos_in[order] = place - seen[group[np.searchsorted(group, np.arange(m), "right") - 1]]
        # The key of a member is two tokens before its value, in its container.
        self.key = np.full(m, -1, np.int64)
        members = np.flatnonzero(is_value & in_object)
        self.key[order[members]] = order[np.maximum(members - 2, 0)]
        self.is_value = np.zeros(m, bool)
        self.is_value[order] = is_value
        self.start, self.end, self.kind, self.doc, self.holder = pos, end, kind, doc, holder
        seen_scalars: dict[bytes, bool] = {}
        for t in np.flatnonzero(kind == SCALAR):
            w = self.raw[pos[t] : end[t]]
            ok = seen_scalars.get(w)
            if ok is None:
                ok = seen_scalars[w] = w in (b"true", b"false", b"null") or bool(_NUMBER.match(w))
            if not ok:
                valid[doc[t]] = False
        self.valid = valid
        self.root = np.full(len(texts), -1, np.int64)
        tops = np.flatnonzero(self.is_value & (holder < 0))
        self.root[doc[tops]] = tops
        self.root[~valid] = -1
        self._named: dict[bytes, np.ndarray] = {}
        self._members = np.flatnonzero(self.is_value & (self.key >= 0))

    def named(self, name: str) -> np.ndarray:
        """For every container the index of its member of that name (the last, if repeated), else -1."""
        want = json.dumps(name, ensure_ascii=False).encode()
        if want not in self._named:
            out = np.full(len(self.start), -1, np.int64)
            ks = self.key[self._members]
            s, size = self.start[ks], self.end[ks] - self.start[ks]
            hit = size == len(want)
            c = np.flatnonzero(hit)
            for i, byte in enumerate(want):
                c = c[self.buf[s[c] + i] == byte]
            hit[:] = False
            hit[c] = True
            for i in np.flatnonzero(size > len(want)):  # keys written with escapes
                w = self.raw[s[i] : s[i] + size[i]]
                if b"\\" in w and json.loads(w) == name:
                    hit[i] = True
            picked = self._members[hit]
            out[self.holder[picked]] = picked  # in text order, so the last one stays
            self._named[want] = out
        return self._named[want]

    def get(self, values: np.ndarray, name: str, kind: int | None = None) -> np.ndarray:
        """The member ``name`` of each value, -1 where there is none (or not of that kind)."""
        got = np.where(values >= 0, self.named(name)[np.maximum(values, 0)], -1) if len(self.start) else np.full(len(values), -1)
        if kind is not None and len(self.start):
            got = np.where((got >= 0) & (self.kind[np.maximum(got, 0)] == kind), got, -1)
        return got

    def is_null(self, values: np.ndarray) -> np.ndarray:
        """Whether the value is absent or null."""
        if not len(self.start):
            return np.ones(len(values), bool)
        v = np.maximum(values, 0)
        return (values < 0) | ((self.kind[v] == SCALAR) & (self.buf[self.start[v]] == 110))

    def items(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, place, item): the items of each array; any other value than null is a list of one."""
        owner = np.flatnonzero(~self.is_null(values))
        if not len(owner):
            return owner, owner, owner
        v = values[owner]
        lists = self.kind[v] == OPEN_A
        at = np.full(len(self.start), -1, np.int64)
        at[v[lists]] = owner[lists]
        inner = np.flatnonzero(self.is_value & (self.holder >= 0) & (at[np.maximum(self.holder, 0)] >= 0))
        o = np.concatenate([owner[~lists], at[self.holder[inner]]])
        p = np.concatenate([np.zeros((~lists).sum(), np.int64), self.pos_in[inner]])
        i = np.concatenate([v[~lists], inner])
        by = np.lexsort((p, o))
        return o[by], p[by], i[by]

    def text(self, value: int) -> str | None:
        """Strings decoded, null as None, all else as its JSON text."""
        if value < 0:
            return None
        w = self.raw[self.start[value] : self.end[value]]
        if self.kind[value] == STRING:
            if b"\\" not in w:
                return w[1:-1].decode()
            # Half a surrogate pair has no UTF-8 form and becomes the replacement character.
            return json.loads(w).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return None if w == b"null" else w.decode()

    def texts(self, values: np.ndarray) -> list[str | None]:
        return [self.text(v) for v in values]
