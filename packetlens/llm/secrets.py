"""Secret scan in DataFrame expressions only: key patterns, and sliding-window entropy per character class.

A pattern's matches and the stretches between them come from one regexp_extract_all and one split, so the running sum
of their lengths, taken in blocks, gives every match's place in code points. Candidate strings for the entropy scan
are runs of key characters; a window of 20 characters slides over each, its Shannon entropy kept by incremental
counts: one character enters, one leaves, and only their two terms of sum(n * log2 n) change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be matched first
WINDOW = 20
#: Candidate strings of the entropy scan.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are looked into: letters with a digit among them, or letters only.
PLAUSIBLE = "[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|^[A-Za-z]+$"
#: Character class: what the candidate wholly consists of, its alphabet, and the least entropy of a window in bits.
CLASSES = (
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("lower", "^[a-z]*[0-9][a-z0-9]*$", "0123456789abcdefghijklmnopqrstuvwxyz", 3.6),
    ("upper", "^[A-Z]*[0-9][A-Z0-9]*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    ("letters", "^[A-Za-z]+$", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 4.0),
    ("base64", "", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.8),
)
#: Candidates that are known not to be secrets: UUIDs, words of common length joined by signs with a number at their end,
#: paths, numbers, placeholders.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[-_/=+]?[A-Za-z]{2,15}([-_/=+][A-Za-z]{2,15})*[-_/=+]?[0-9]{0,6}$",
    "^[0-9+/_=-]+$",
    "(?i)(example|placeholder|changeme|dummy|xxxx)",
)


#: A place behind every text.
FAR = (1 << 31) - 1
SPANS = "array<struct<start: int, stop: int, kind: string, word: string>>"
#: Members of a block of a running value, and levels of blocks of blocks.
RUN, LEVELS = 32, 4
#: Code points of a piece that a text is cut into before spans are taken out of it.
PIECE = 1024


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not again for each step of a loop inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, zero: Column, levels: int = LEVELS) -> Column:
    """Running results of the associative ``op`` over an array: block by block, the blocks' totals likewise.

    An array that grows step by step is copied at each; here none that grows is longer than RUN, but for the totals of
    the last level, one for RUN ** LEVELS members.
    """

    def grown(array: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = op(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(array, F.struct(first.alias("at"), F.array_remove(F.array(zero), zero).alias("out")), step)["out"]

    if not levels:
        return _bound(values, lambda v: grown(v, zero))

    def in_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda b: F.slice(v, b * RUN + 1, F.lit(RUN)))

        def from_totals(k: Column) -> Column:
            totals = F.transform(k, lambda b: F.aggregate(b, zero, lambda a, x: op(a, x)))
            return _bound(
                running(totals, op, zero, levels - 1),
                lambda t: F.flatten(F.transform(k, lambda b, i: grown(b, F.when(i > 0, F.get(t, i - 1)).otherwise(zero)))),
            )

        return F.when(F.size(v) <= RUN, grown(v, zero)).otherwise(_bound(blocks, from_totals))

    return _bound(values, in_blocks)


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, stop, kind, word) of the pattern's leftmost non-overlapping matches, in code points."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, w: F.length(g) + F.length(w))
        return F.zip_with(
            running(sizes, lambda a, b: a + b, F.lit(0)), found,
            lambda stop, w: F.struct((stop - F.length(w)).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), w.alias("word")),
        )

    some = lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPANS))
    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _terms(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(word: Column, alphabet: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of the word's windows, by incremental counts of its characters."""
    chars = F.transform(F.split(word, ""), lambda c: F.call_function("instr", alphabet, c) - 1)
    # each character with the one that leaves the window as it enters, -1 for none
    shifted = F.concat(F.array_repeat(F.lit(-1), window), chars)
    steps = F.slice(F.zip_with(chars, shifted, lambda c, o: F.struct(c.alias("c"), o.alias("out"))), F.lit(1), F.length(word))
    # a window's counts are one string, a character for each of the alphabet: '0' and the count above it
    count = lambda counts, c: F.ascii(F.substring(counts, c + 1, F.lit(1))) - 48
    put = lambda counts, c, n: F.overlay(counts, F.char(n + 48), c + 1, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        out = x["out"]
        come, gone = count(acc["n"], x["c"]), count(acc["n"], out)
        same = out == x["c"]
        s = acc["s"] + F.when(same, 0.0).otherwise(
            _terms(come + 1) - _terms(come) + F.when(out >= 0, _terms(gone - 1) - _terms(gone)).otherwise(F.lit(0.0))
        )
        entered = put(acc["n"], x["c"], come + 1)
        n = F.when(same, acc["n"]).when(out >= 0, put(entered, out, gone - 1)).otherwise(entered)
        seen = acc["seen"] + 1
        top = F.when(seen >= window, F.greatest(acc["top"], F.log2(F.lit(float(window))) - s / F.lit(float(window)))).otherwise(acc["top"])
        return F.struct(n.alias("n"), s.alias("s"), top.alias("top"), seen.alias("seen"))

    first = F.struct(F.repeat(F.lit("0"), F.length(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("top"), F.lit(0).alias("seen"))
    return F.aggregate(steps, first, step)["top"]


def _entropy_hits(text: Column) -> Column:
    """Candidates whose class's window entropy is reached and that no allow-list pattern takes."""

    fields = ("start", "stop", "kind", "word")

    def classed(w: Column) -> Column:
        """The candidate with its class's alphabet and threshold, so that they are found once, not for each character."""
        alphabet, least = F.lit(CLASSES[-1][2]), F.lit(CLASSES[-1][3])
        for _, whole, letters, bits in reversed(CLASSES[:-1]):
            alphabet = F.when(w["word"].rlike(whole), F.lit(letters)).otherwise(alphabet)
            least = F.when(w["word"].rlike(whole), F.lit(bits)).otherwise(least)
        return F.struct(*(w[k].alias(k) for k in fields), alphabet.alias("alphabet"), least.alias("least"))

    allowed = lambda w: F.greatest(*[w["word"].rlike(p).cast("int") for p in ALLOW]) == 1
    plausible = F.filter(_located(text, CANDIDATE, "entropy"), lambda w: w["word"].rlike(PLAUSIBLE) & ~allowed(w))
    each = F.transform(plausible, classed)
    high = F.filter(each, lambda w: F.round(window_entropy(w["word"], w["alphabet"]), 9) >= w["least"])
    return F.transform(high, lambda w: F.struct(*(w[k].alias(k) for k in fields)))


def _clear(spans: Column) -> Column:
    """Spans by start, without the entropy spans that touch another one: the furthest end of the base spans before and
    at each place, and the nearest start of those from it on, tell which."""
    more = lambda w: w["kind"] == "entropy"

    def kept(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda w: F.when(more(w), 0).otherwise(w["stop"])), F.greatest, F.lit(0))
        starts = F.transform(F.reverse(all_), lambda w: F.when(more(w), FAR).otherwise(w["start"]))
        starts = F.reverse(running(starts, F.least, F.lit(FAR)))
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        each = F.zip_with(all_, near, lambda w, x: F.struct(w.alias("w"), (more(w) & ((x["end"] > w["start"]) | (x["start"] < w["stop"]))).alias("gone")))
        return F.transform(F.filter(each, lambda x: ~x["gone"]), lambda x: x["w"])

    return _bound(spans, kept)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex (long), base_sha256, spans (strings), and secret_spans, an array of
    (start, stop, kind, word), by start, then kind as listed, entropy last.

    Places are code points, ends exclusive. Entropy spans that touch a base span are left out: the base one stays.
    Null texts count as empty and have no spans. Each row is scanned by itself, whole, whatever its length; an empty
    table gives no rows, repeated rows repeat. Columns of ``docs`` with one of the new names are replaced.
    """
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans")
    kept = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPANS)
    # cheap tests first, so that the searches run only where they can match
    gate = lambda p, x: F.when(text.rlike(p), x).otherwise(none)
    value = lambda w: F.regexp_extract(w["word"], ASSIGN, 2)
    assign = gate("(?i:passw|secret|token|api_?key)", F.filter(_located(text, ASSIGN, "assign"), lambda w: F.length(value(w)) >= 6))
    access = gate("AKIA", F.filter(_located(text, ACCESS, "access"), lambda w: F.length(w["word"]) >= 20))
    hexes = gate(HEX, _located(text, HEX, "hex"))
    order = {k: i for i, k in enumerate((*KINDS, "entropy"))}

    def placed(spans: Column) -> Column:
        rank = lambda w: F.when(w["kind"] == "assign", order["assign"]).when(w["kind"] == "access", order["access"]).when(w["kind"] == "hex", order["hex"]).otherwise(order["entropy"])
        keyed = F.transform(spans, lambda w: F.struct(w["start"].alias("start"), rank(w).alias("rank"), w["stop"].alias("stop"), w["kind"].alias("kind"), w["word"].alias("word")))
        return F.transform(F.sort_array(keyed), lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), w["kind"].alias("kind"), w["word"].alias("word")))

    joined = lambda spans: F.array_join(F.transform(spans, lambda w: F.concat_ws(":", w["kind"], w["start"].cast("string"), w["stop"].cast("string"))), ",")
    found = docs.select(*kept, assign.alias("found assign"), access.alias("found access"), hexes.alias("found hex"), gate("[A-Za-z0-9+/_=-]{20}", _entropy_hits(text)).alias("found more"))
    base = F.concat("found assign", "found access", "found hex")
    some = F.size(base) > 0
    found = found.select(
        *kept,
        *(F.size(f"found {k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.when(some, placed(base)).otherwise(base).alias("found base"),
        F.when(some & (F.size("found more") > 0), _clear(placed(F.concat(base, "found more")))).when(some, placed(base)).otherwise(F.col("found more")).alias("secret_spans"),
    )
    return found.select(
        *kept,
        "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("found base")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
        "secret_spans",
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; overlapping spans become one mark.

    A null text stays null; texts without a span are unchanged.
    """
    found = scanned(docs)
    text, spans = F.col("text"), F.col("secret_spans")
    ends = running(F.transform(spans, lambda w: w["stop"]), F.greatest, F.lit(0))

    def cut(pieces: Column, at: Column, to: Column) -> Column:
        """Code points ``at`` to ``to`` of the text, from the few pieces that hold them."""
        first = F.floor(at / PIECE).cast("int")
        few = F.array_join(F.slice(pieces, first + 1, F.floor(to / PIECE).cast("int") - first + 1), "")
        return F.substring(few, at - first * PIECE + 1, to - at)

    def masked(pieces: Column, e: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))
        kept = F.transform(spans, lambda w, i: F.when(w["start"] >= before(i), F.concat(cut(pieces, before(i), w["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), cut(pieces, F.get(e, F.size(e) - 1), F.length(text)))

    whole = _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: _bound(ends, lambda e: masked(pieces, e)))
    return found.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(text)).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for the counts and spans of ``scanned``: every window is counted by itself."""
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    found = " union all ".join(
        f"select doc_id, '{k}' kind, {r} ord, regexp_extract_all(t, {quoted(p)}) w, string_split_regex(t, {quoted(p)}) g from t where regexp_matches(t, {quoted(p)})"
        for r, (k, p) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)))
    )
    least = "case " + " ".join(f"when regexp_matches(word, {quoted(p)}) then {bits}" for _, p, _, bits in CLASSES[:-1]) + f" else {CLASSES[-1][3]} end"
    allowed = " or ".join(f"regexp_matches(word, {quoted(p)})" for p in ALLOW)
    listed = lambda table: f"(select doc_id, string_agg(kind || ':' || a || ':' || b, ',' order by a, ord, b) s from {table} group by doc_id)"
    return f"""
with t as (select doc_id, coalesce(text, '') t from documents), f as ({found}),
p as (select doc_id, kind, ord, unnest(w) word, unnest(range(1, len(w) + 1)) i, w, g from f),
q as (select doc_id, kind, ord, word, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::bigint a from p),
x as (select *, a + length(word) b from q),
base as (select * from x where (kind = 'assign' and length(regexp_extract(word, {quoted(ASSIGN)}, 2)) >= 6) or (kind = 'access' and length(word) >= 20) or kind = 'hex'),
cand as (select * from x where kind = 'entropy' and regexp_matches(word, {quoted(PLAUSIBLE)}) and not ({allowed})
  and not exists (select 1 from base where base.doc_id = x.doc_id and base.a < x.b and x.a < base.b)),
win as (select doc_id, a, word, unnest(range(1, length(word) - {WINDOW - 2})) k from cand),
ch as (select doc_id, a, word, k, unnest(string_split(substr(word, k::int, {WINDOW}), '')) c from win),
n as (select doc_id, a, word, k, c, count(*)::double n from ch where c <> '' group by all),
e as (select doc_id, a, word, k, -sum(n / {WINDOW} * log2(n / {WINDOW})) bits from n group by all),
top as (select doc_id, a, word, round(max(bits), 9) bits from e group by all),
more as (select cand.* from cand join top using (doc_id, a, word) where top.bits >= {least}),
spans as (select doc_id, kind, ord, a, b from base union all select doc_id, kind, ord, a, b from more),
c as (select doc_id, count(*) filter (where kind = 'assign') na, count(*) filter (where kind = 'access') nk, count(*) filter (where kind = 'hex') nh from base group by doc_id)
select t.doc_id, coalesce(na, 0)::bigint n_assign, coalesce(nk, 0)::bigint n_access, coalesce(nh, 0)::bigint n_hex, sha256(coalesce(bs.s, '')) base_sha256, coalesce(ss.s, '') spans
from t left join c using (doc_id) left join {listed('base')} bs using (doc_id) left join {listed('spans')} ss using (doc_id)"""
