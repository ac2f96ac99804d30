"""The tokens of SQL scripts with what stands around each of them, batch by batch: running sums and last values as array operations.

A script stands in one row, so the task that holds the row can tell all places without sending a token anywhere: nothing is shuffled, sorted
on disk or settled but what the extractors keep. Scripts go through in slices of ``SLICE`` characters; a longer one goes alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

#: A literal, a name of up to eight parts, a script variable, a number, white space, an operator of two characters, any other character.
_TOKEN = re.compile(r"""[Nn]?'[^']*+'|(?:\[[^\]]*+\]|"[^"]*+"|[#A-Za-z_][\w$#]*+)(?:\s*+\.\s*+(?:\[[^\]]*+\]|"[^"]*+"|[A-Za-z_][\w$#]*+)){0,7}+|@{1,2}\w++|\d[\w.]*+|\s++|<>|[-+*/%&|^<>!]=|.""", re.ASCII | re.DOTALL)
_SPACES = " \t\n\r\f\v"
_NAMES = frozenset('["#_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')
OPERATORS = ("=", "<", ">", "+", "-", "*", "/", "%", "<>", "<=", ">=", "!=")
#: Words that begin a statement by themselves, and those before which they are names or parts of another one.
BEGINNERS = ("DECLARE", "EXEC", "EXECUTE", "GO", "TRUNCATE", "CREATE", "DROP", "ALTER", "IF", "WHILE", "PRINT", "RETURN", "RAISERROR", "THROW", "USE", "COMMIT", "ROLLBACK", "GRANT", "REVOKE", "DENY", "OPEN", "CLOSE", "DEALLOCATE", "FETCH", "WAITFOR", "BREAK", "CONTINUE")
_NOT_AFTER = ("SELECT", ",", "(", "AND", "OR", "NOT", "BY", "ON", "WHERE", "AS", "FROM", "JOIN", "DISTINCT", "SET", "LIKE", "IN", "BETWEEN", "WHEN", "THEN", "INTO", "TABLE", "ROWS", "ROW", "FOR", *OPERATORS)
CHANGES = ("INSERT", "UPDATE", "DELETE", "MERGE")
#: Words that begin a clause; those that list what is read.
CLAUSES = ("SELECT", "FROM", "JOIN", "ON", "WHERE", "GROUP", "HAVING", "ORDER", "SET", "VALUES", "INTO", "USING", "APPLY", "OPTION", "OUTPUT", *CHANGES)
LISTS = ("FROM", "JOIN", "ON", "APPLY")
SLICE = 200_000

_STRINGS = "token word before1 before2 before3 after1 after2 block first clause opener closed_opener changed closed1 closed2 o_before1 o_clause o_cte o_closed1 o_closed2 s_before1 s_before2".split()
_NUMBERS = "pos end line start level next_end pair statement until case_depth depth query part base scope scope_no parent scope_to scope_end_line".split()
_FLAGS = "spaced head cte read opened".split()
_ARROW = pa.schema([("file_name", pa.string()), *[(c, pa.string()) for c in _STRINGS], *[(c, pa.int32()) for c in _NUMBERS], *[(c, pa.bool_()) for c in _FLAGS]])
SCHEMA = ", ".join(["file_name string", *[f"{c} string" for c in _STRINGS], *[f"{c} int" for c in _NUMBERS], *[f"{c} boolean" for c in _FLAGS]])


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of batches of scripts (file_name, text)."""
    for part in parts:
        names, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        begin, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= SLICE or i == len(texts) - 1:
                yield _told(names[begin : i + 1], texts[begin : i + 1])
                begin, held = i + 1, 0


class _Groups:
    """Rows with equal keys, in order of their places: a window partition each."""

    def __init__(self, *keys: np.ndarray) -> None:
        n = len(keys[0])
        one = np.zeros(n, np.int64)
        for k in keys:
            one = one * (int(k.max()) - int(k.min()) + 1) + (k - k.min()) if n else one
            if n and one.max() > 2**40:
                one = np.unique(one, return_inverse=True)[1]
        self.order = np.argsort(one, kind="stable")
        one = one[self.order]
        new = np.ones(n, bool)
        new[1:] = one[1:] != one[:-1]
        self.begins = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1

    def _back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def running(self, x: np.ndarray) -> np.ndarray:
        """Sums up to each row."""
        x = x[self.order].astype(np.int64)
        run = np.cumsum(x)
        return self._back(run - (run - x)[self.begins][self.group])

    def _last(self, valid: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(valid[self.order], np.arange(len(valid)), -1)) if len(valid) else np.zeros(0, np.int64)
        return np.where(at >= self.begins[self.group], self.order[at], -1)

    def last(self, valid: np.ndarray) -> np.ndarray:
        """The last row that is valid up to each row, -1 if there is none."""
        return self._back(self._last(valid))

    def only(self, valid: np.ndarray) -> np.ndarray:
        """The last row that is valid of the whole group."""
        ends = np.append(self.begins[1:], len(valid)) - 1
        return self._back(self._last(valid)[ends][self.group])

    def head(self, valid: np.ndarray) -> np.ndarray:
        """The first row that is valid of the whole group."""
        n = len(valid)
        at = np.minimum.reduceat(np.where(valid[self.order], self.order, n), self.begins)[self.group] if n else np.zeros(0, np.int64)
        return self._back(np.where(at == n, -1, at))

    def least(self, x: np.ndarray) -> np.ndarray:
        return self._back(np.minimum.reduceat(x[self.order], self.begins)[self.group]) if len(x) else x

    def most(self, x: np.ndarray) -> np.ndarray:
        return self._back(np.maximum.reduceat(x[self.order], self.begins)[self.group]) if len(x) else x


def _told(names: list[str], texts: list[str]) -> pa.RecordBatch:
    """All tokens but white space of some scripts. Strings are numbers of a dictionary until the end, -1 being null."""
    cut = [[*_TOKEN.findall(t), " "] for t in texts]  # so that none is empty
    file = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    flat = np.empty(len(file), object)
    flat[:] = list(chain.from_iterable(cut))
    code, found = pd.factorize(flat)
    terms = list(dict.fromkeys(chain(found, (t.upper() for t in found), ("WITH", "OTHER", "FROM"))))  # tokens first, so their numbers stay
    number = {t: i for i, t in enumerate(terms)}
    upper = np.array([number[t.upper()] for t in found] + [-1] * (len(terms) - len(found) + 1), np.int64)
    rest = range(len(found), len(terms))
    upper[len(found) : len(terms)] = [number.get(terms[i].upper(), i) for i in rest]

    def told(test) -> np.ndarray:
        """Of each term whether it passes a test; null does not."""
        return np.array([*map(test, terms), False], bool)

    def among(x: np.ndarray, *words: str) -> np.ndarray:
        listed = np.zeros(len(terms) + 1, bool)
        listed[[number[w] for w in words if w in number]] = True
        return listed[x]

    size = np.array([*map(len, terms), 0], np.int64)[code]
    breaks = np.array([*(t.count("\n") for t in terms), 0], np.int64)[code]
    white = told(lambda t: t[:1] in _SPACES and t != "")[code]
    by_file = _Groups(file)
    end = by_file.running(size)
    line = by_file.running(breaks) - breaks + 1
    pos = np.arange(len(file)) - by_file.begins[by_file.group] if len(file) else file
    spaced = np.zeros(len(file), bool)
    spaced[1:] = white[:-1] & (file[1:] == file[:-1])

    keep = np.flatnonzero(~white)
    if not len(keep):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _ARROW], names=_ARROW.names)
    file, token, size, end, line, pos, spaced = (x[keep] for x in (file, code, size, end, line, pos, spaced))
    n = len(file)

    def moved(x: np.ndarray, k: int) -> np.ndarray:
        """Values of the row ``k`` before (after, if negative), -1 where that is of another script."""
        out = np.full(n, -1, np.int64)
        if k > 0:
            out[k:] = np.where(file[k:] == file[:-k], x[:-k], -1)
        else:
            out[:k] = np.where(file[:k] == file[-k:], x[-k:], -1)
        return out

    def taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.append(x, -1)[at]

    word = upper[token]
    before1, before2, before3, after1, after2 = moved(word, 1), moved(word, 2), moved(word, 3), moved(token, -1), moved(token, -2)
    up1, up2 = upper[after1], upper[after2]
    opening, closing = among(token, "("), among(token, ")")
    is_name = told(lambda t: t[0] in _NAMES and t[:2].lower() != "n'")[token]
    by_file = _Groups(file)
    level = by_file.running(opening.astype(int) - closing) + closing
    pair = _Groups(file, level).running(opening)
    by_pair = _Groups(file, level, pair)

    # blocks: CASE or BEGIN
    begins = among(word, "CASE") | (among(word, "BEGIN") & ~among(up1, "TRAN", "TRANSACTION", "DISTRIBUTED", "DIALOG"))
    ends = among(word, "END")
    run = by_file.running(np.where(begins, 1, np.where(ends, -1, 0)))
    block = taken(word, _Groups(file, np.where(ends, run, run - 1)).last(begins))
    in_case = among(block, "CASE")
    case_opens, case_closes = among(word, "CASE"), ends & in_case
    case_depth = by_file.running(case_opens.astype(int) - case_closes) + case_closes - 1

    # statements, which need no semicolons
    outside = (level == 0) & ~in_case
    cte = among(word, "WITH") & among(up2, "AS", "(") & told(lambda t: t[0] in _NAMES and t[0] != "#")[after1] & ~among(up1, "SCHEMABINDING", "ENCRYPTION", "RECOMPILE", "EXECUTE")
    change = among(word, *CHANGES) & ~among(before1, "THEN", "ON", "FOR", "AFTER", "OF", ",", "AS", "OR") & ~among(up1, "(", "JOIN")
    other = (among(word, *BEGINNERS) & ~among(before1, *_NOT_AFTER) & ~among(up1, ",", ".", *OPERATORS)) | among(word, "BEGIN", "END", "ELSE")
    marks = outside & (cte | change | other | among(word, "SELECT", "SET", "VALUES", ";", *CHANGES))
    earlier = taken(np.where(cte, number["WITH"], word), moved(by_file.last(marks), 1))
    select = among(word, "SELECT") & ~among(before1, "UNION", "EXCEPT", "INTERSECT", "AS", "FOR", "THEN") & ~(among(before1, "ALL") & (among(before2, "UNION") | (before2 < 0))) & ~among(earlier, "INSERT", "WITH")
    head = marks & (cte | other | select | (change & ~among(earlier, "WITH")) | (among(word, "SET") & ~among(earlier, "UPDATE", "MERGE")))
    statement = by_file.running(head)
    cte &= marks
    by_statement = _Groups(file, statement)
    first = taken(word, by_statement.head(np.ones(n, bool)))

    # query blocks: brackets that ask, and in them the how-manieth SELECT
    asks = taken(by_pair.only(opening & among(up1, "SELECT", "WITH")), np.arange(n)) >= 0
    opener = taken(before1, by_pair.only(opening))
    inner, outer = opening & asks, closing & asks
    depth = by_file.running(inner.astype(int) - outer) + outer
    query = _Groups(file, depth).running(inner)
    by_query = _Groups(file, statement, depth, query)
    selects = by_query.running(among(word, "SELECT"))
    part = np.where(depth > 0, np.maximum(selects, 1), selects)
    base = by_query.least(level)
    by_scope = _Groups(file, statement, depth, query, part)
    scope_row = by_scope.head(np.ones(n, bool))
    scope = pos[scope_row]
    own = level == base
    clause_word = among(word, *CLAUSES)
    means = np.where(own & clause_word & ~(among(word, "FROM") & among(before1, "DISTINCT")), word, -1)
    means = np.where((head & ~clause_word) | cte | (head & among(word, "SET")), number["OTHER"], means)
    clause = taken(means, by_query.last(means >= 0))
    # a comma after the condition of a join goes on with what is read
    means = np.where(own & among(token, ",") & among(clause, *LISTS), number["FROM"], means)
    clause = taken(means, by_query.last(means >= 0))
    read = (among(before1, ",") & own & among(clause, *LISTS)) | (among(before1, "FROM", "JOIN") & own & among(clause, "FROM", "JOIN"))
    target = (among(before1, "INTO") & among(before2, "INSERT", "MERGE")) | (among(before1, "UPDATE", "MERGE") & ~among(word, "INTO", "TOP", "SET")) | (among(before1, "INSERT") & ~among(word, "INTO")) | (among(before1, "DELETE") & ~among(word, "FROM", "TOP"))
    changed = taken(token, by_statement.head(is_name & target))

    # of the first row of each query block: its number, extent, and the brackets and words that open it
    begin = scope_row == np.arange(n)
    scope_no = by_file.running(begin)
    opened_by = np.where(depth > 0, _Groups(file, depth, query).only(inner), -1)
    around = taken(scope_row, np.where(opened_by >= 0, moved(np.arange(n), 1)[opened_by], -1))
    parent = taken(scope_no, around)
    to, to_line = by_scope.most(end), by_scope.most(line)
    inside = np.flatnonzero(begin & (around >= 0))
    to_all, line_all = to.copy(), to_line.copy()
    np.maximum.at(to_all, around[inside], to[inside])
    np.maximum.at(line_all, around[inside], to_line[inside])
    closes = by_pair.only(closing)
    closed1, closed2 = taken(after1, closes), taken(after2, closes)
    is_other = among(clause, "OTHER")
    cte_name = np.where(is_other, taken(token, by_query.last(among(before1, "WITH", ",") & is_name & own & is_other)), -1)
    chosen = by_scope.head(among(word, "SELECT"))
    of_opener = lambda x: np.where(begin, taken(x, opened_by), -1)

    texts_ = pa.array(terms, pa.string())
    strings = {"token": token, "word": word, "before1": before1, "before2": before2, "before3": before3, "after1": after1, "after2": after2, "block": block, "first": first, "clause": clause, "opener": opener, "closed_opener": moved(opener, 1), "changed": changed, "closed1": np.where(opening, closed1, -1), "closed2": np.where(opening, closed2, -1), "o_before1": of_opener(before1), "o_clause": of_opener(moved(clause, 1)), "o_cte": of_opener(moved(cte_name, 1)), "o_closed1": of_opener(closed1), "o_closed2": of_opener(closed2), "s_before1": np.where(begin, taken(before1, chosen), -1), "s_before2": np.where(begin, taken(before2, chosen), -1)}
    numbers = {"pos": pos, "end": end, "line": line, "start": end - size, "level": level, "next_end": moved(end, -1), "pair": pair, "statement": statement, "until": by_statement.most(end), "case_depth": case_depth, "depth": depth, "query": query, "part": part, "base": base, "scope": scope, "scope_no": taken(scope_no, scope_row), "parent": np.where(begin, parent, -1), "scope_to": to_all, "scope_end_line": line_all}
    flags = {"spaced": spaced, "head": head, "cte": cte, "read": read, "opened": opened_by >= 0}
    nulls = ("next_end", "parent")
    columns = [pa.array(names, pa.string()).take(pa.array(file))]
    columns += [texts_.take(pa.array(strings[c], mask=strings[c] < 0)) for c in _STRINGS]
    columns += [pa.array(numbers[c].astype(np.int32), mask=(numbers[c] < 0) if c in nulls else None) for c in _NUMBERS]
    columns += [pa.array(flags[c]) for c in _FLAGS]
    return pa.RecordBatch.from_arrays(columns, names=_ARROW.names)
