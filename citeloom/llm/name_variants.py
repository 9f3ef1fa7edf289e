"""Variant spellings of names: prefix-filtered set-similarity joins, soft weighted verification.

Method
    1. A typed name becomes tokens: words, initials, acronyms; titles, particles and function words fall
       away, and a particle glued to a family name is cut off.  Names with equal tokens form one class.
    2. Distinct tokens that are typos of one another (``close_tokens``) share what is left of them when as many
       letters are deleted as edits are allowed; they are joined on that, then checked.  A token's frequency is
       summed over its neighbours, so a typo of a common word is as common as the word; its *lead* is the most
       frequent of them.  Words under ``least_letters`` letters make no names meet as typos: one letter makes another name.
    3. Names become candidates by three kinds of keys.  A name's prefix, its rarest tokens (weight within
       ``prefix_share`` of its greatest), joins with equal tokens and neighbours.  A pair of words of a person,
       as lead and full form of a nickname, joins with the same pair, so that a family name however common,
       which is in no prefix, still finds the given name's other spellings.  A person with one word and initials
       joins with those who have the word and a name with that first letter.
    4. Candidates are verified by a soft token similarity weighted by rarity, where equal words, typos,
       nicknames, initials, abbreviations and acronyms count as matches, and given names or words of an
       organisation's subject that contradict each other veto the pair.
    5. A name with initials only, whose candidates contradict each other, is linked to those that share
       its second initial if these agree, or else to none but equals; least and greatest given names tell, no
       name's candidates are gathered.  What is left is closed by connected components.

Defined results: a row with no letters in any field is in no group; nulls count as empty; repeated rows of
a key count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.canonical_text import canonical
from citeloom.operators.graph import connected_components
from citeloom.session import materialize, measured_joins
from citeloom.sources.spread import spread


@dataclass(frozen=True)
class Params:
    least_typo: int = 3  # letters a word needs to be a typo of another one
    least_letters: int = 4  # letters that two words need to make names meet as typos
    prefix_share: float = 0.75
    score: float = 0.5
    organisation_score: float = 0.8


# Words that carry no identity.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md msc bsc jr sr ii iii iv".split())
PARTICLES = frozenset("van von der den de di da du del della la le ter ten zu zur do dos das st".split())
FUNCTION_WORDS = frozenset("of for the and at in on to an und".split())
GLUED = re.compile(r"^(?:vander|vonder|vande|dela|della|van|von|ter|ten|di|de|da|du)(?=[a-z]{5})")
# Kinds of organisations; a name with one of these words or its abbreviation is an organisation.
KINDS = (
    "academy agency archive association board bureau center centre clinic college commission committee company consortium corporation council "
    "department division faculty federation foundation hospital institute institution laboratory library ministry museum network observatory office "
    "organisation organization programme school society station survey trust union university"
).split()
KIND_ABBREVIATIONS = frozenset("acad assoc cent ctr coll corp dept fac found hosp inst lab labs lib mus obs org sch soc univ".split())
# Short forms of given names, each line a full form with its short forms.
NICKNAMES = """
alexander alex sandy xander sasha|alexandra lexi|andrew andy drew|anthony tony|benjamin ben benny|catherine cathy|charles charlie chuck chas|christopher chris kit
christine chrissy tina|daniel dan danny|david dave davy|deborah deb debbie|dorothy dot dottie dolly|edward ed eddie ted ned|elizabeth liz beth betty lizzie eliza
francisco paco pancho|frederick fred freddie freddy|gabriel gabe|george geordie|gregory greg|guillermo memo|harold hal harry|henry hank|jacob jake|james jim jimmy jamie
jennifer jen jenny|jonathan jon|john johnny jack|joseph joe joey|joshua josh|katherine kate kathy katie|kenneth ken kenny|lawrence larry laurie|leonard len lenny
margaret maggie peggy meg marge|matthew matt|michael mike mick mickey|mikhail misha|nicholas nick nicky|patricia pat patty tricia trish|patrick paddy pat|peter pete
philip phil|raymond ray|rebecca becky becca|richard rick dick rich ricky|robert bob rob bobby robbie|ronald ron ronnie|samuel sam sammy|stephen steve steven
susan sue susie suzy|theodore theo teddy|thomas tom tommy|timothy tim|victoria vicky vic tori|vincent vince vinny|william bill will billy willy liam|zachary zach zack
ekaterina katya|rajesh raj|vikram vik|zofia zosia|ulrike uli|johannes hannes hans
abigail abby gail|gerald gerry jerry|ronald ron|donald don donnie|arthur art|walter walt|nathaniel nate nathan|jeffrey jeff|terence terry|martin marty
"""
_FORMS = [line.split() for row in NICKNAMES.split("\n") for line in row.split("|") if line]
NICK = {short: tuple(sorted({f[0] for f in _FORMS if short in f[1:]})) for f in _FORMS for short in f[1:]}
_WHOLE = frozenset(NICK) | frozenset(f[0] for f in _FORMS)  # given names, which no particle is cut from
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = tuple(KINDS)


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", canonical(s))
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("ß", "ss")


@lru_cache(200_000)
def is_kind(token: str) -> bool:
    return token in KIND_ABBREVIATIONS or token in _STEMS or any(len(token) > 5 and edit_distance(token, k, 1) <= 1 for k in _STEMS if k[0] == token[0])


@lru_cache(200_000)
def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insertion, deletion, substitution, swap of neighbours) up to ``most``, else most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def close_tokens(a: str, b: str) -> bool:
    """Typos of one another: one edit, or two in words of eight letters or more."""
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if len(set(a) ^ set(b)) > 2 * most:  # an edit changes two kinds of letters at most
        return False
    return edit_distance(a, b, most) <= most


def tokens_of(family: str | None, given: str | None, literal: str | None) -> list[str]:
    """Tokens 'w:word', 'i:x' (an initial) and 'a:xyz' (capitals that may be initials or an acronym), in order."""
    out: list[str] = []
    fields = [f for f in (given, family, literal) if f]
    whole = " ".join(fields)
    shouting = whole.upper() == whole
    words = [_WORD.findall(_plain(f)) for f in fields]
    n_long = sum(len(w) > 3 for ws in words for w in ws)
    for field, ws in zip(fields, words):
        may_be_glued = field is not given
        for w in ws:
            low = w.lower()
            if low in TITLES and n_long:
                continue
            if len(w) == 1:
                out.append(f"i:{low}")
            elif low in PARTICLES or low in FUNCTION_WORDS:
                continue
            elif w.isupper() and len(w) <= 5 and low not in NICK and n_long and (not shouting or len(w) <= 2):
                out.append(f"a:{low}")
            else:
                out.append(f"w:{low if not may_be_glued or low in _WHOLE or is_kind(low) else GLUED.sub('', low)}")
    return out


def _full(given: str) -> str:
    return NICK.get(given, (given,))[0]


def _fulls(given: str) -> tuple[str, ...]:
    return NICK.get(given, (given,))


def same_given(a: list[str], b: list[str]) -> bool:
    """Whether two lists of given names or initials can be one person's, position by position."""
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = x[2:], y[2:]
        f, g = _fulls(p), _fulls(q)
        if x[0] == y[0] == "w":
            if not _same_word(p, q):
                return False
        elif p[0] != q[0] and not {m[0] for m in f} & {n[0] for n in g}:
            return False
        if i == 1:
            break
    return True


def _same_word(p: str, q: str) -> bool:
    f, g = _fulls(p), _fulls(q)
    return p == q or bool(set(f) & set(g)) or close_tokens(p, q) or any(close_tokens(m, n) for m in f for n in g)


def _contradict(a: list[str], b: list[str]) -> bool:
    """Whether each side has a whole word that no whole word of the other is a form of."""
    x, y = ([t[2:] for t in s if t[0] == "w"] for s in (a, b))
    return any(not any(_same_word(p, q) for q in y) for p in x) and any(not any(_same_word(p, q) for p in x) for q in y)


def _givens(tokens: list[str], family: str) -> list[str]:
    """Tokens but the family name, with runs of capitals as initials; full names keep their order."""
    out = []
    for t in tokens:
        if t == family:
            family = ""
        elif t[0] == "a":
            out += [f"i:{c}" for c in t[2:]]
        else:
            out.append(t)
    return out


def _abbreviates(short: str, long: str) -> bool:
    """The start of the word; for a kind of organisation, some of its letters in order from the first."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    letters, start = iter(long), iter(long[: len(short) + 2])  # the start may hold a typo
    return long.startswith(short) or (len(short) > 2 and all(c in start for c in short)) or (short in KIND_ABBREVIATIONS and is_kind(long) and all(c in letters for c in short))


def content_score(a: list[str], b: list[str], weight_a: list[float], weight_b: list[float]) -> float:
    """Weighted share of the words of two organisations that match; words left over on both sides contradict."""
    rest = list(zip(b, weight_b))
    shared = total = 0.0
    left = False
    for x, w in zip(a, weight_a):
        hit = next(((i, 1.0) for i, (y, _) in enumerate(rest) if x == y), None)
        hit = hit or next(((i, 0.95) for i, (y, _) in enumerate(rest) if close_tokens(x, y) and min(len(x), len(y)) > 3), None)
        hit = hit or next(((i, 0.9) for i, (y, _) in enumerate(rest) if _abbreviates(x, y) or _abbreviates(y, x)), None)
        if hit is None:
            left = True
        else:
            w = min(w, rest.pop(hit[0])[1])  # a short form is rarer than its word
            shared += w * hit[1]
        total += w
    if left and rest:
        return 0.0
    return shared / max(total + sum(w for _, w in rest), 1e-9)


def _taken_apart(name: str) -> tuple[list[str], list[float], dict[str, str], bool]:
    """(tokens, their weights, leads of words, whether an organisation) of a name as ``name_groups`` writes it."""
    tokens, _, known = name.partition("\t")
    tokens, words = tokens.split(" "), [x.split(":") for x in known.split(" ") if x]
    weight = {t: float(w) for t, w, _ in words}
    return tokens, [weight.get(t[2:], 0.5) if t[0] == "w" else 0.5 for t in tokens], {t: lead for t, _, lead in words}, any(t[0] == "w" and is_kind(t[2:]) for t in tokens)


def similarity(a: list[str], b: list[str], key_a: str, key_b: str, weight_a: list[float], weight_b: list[float], may_a: bool = True, may_b: bool = True) -> float:
    """Soft weighted similarity of two names that share the rare token key_a ~ key_b; 0 where they contradict.

    may_a, may_b: False where a name is known to have no kind of organisation.
    """
    fa, fb = f"w:{key_a}", f"w:{key_b}"
    rest_a, rest_b = [t for t in a if t != fa], [t for t in b if t != fb]
    org_a, org_b = (may and any(t[0] == "w" and is_kind(t[2:]) for t in r) for may, r in ((may_a, rest_a), (may_b, rest_b)))
    acronym_a, acronym_b = (len(r) == 1 and r[0][0] == "a" for r in (rest_a, rest_b))
    if org_a or org_b:
        if org_a and org_b:
            own = [[max(w, 0.1) for t, w in zip(ts, ws) if t != f] for ts, ws, f in ((a, weight_a, fa), (b, weight_b, fb))]
            return content_score([t[2:] for t in rest_a], [t[2:] for t in rest_b], *own)
        elif org_a and acronym_b:
            ok = [t[2] for t in sorted(rest_a, key=lambda t: not is_kind(t[2:]))] == list(rest_b[0][2:])
        elif org_b and acronym_a:
            ok = [t[2] for t in sorted(rest_b, key=lambda t: not is_kind(t[2:]))] == list(rest_a[0][2:])
        else:
            ok = False
        return 1.0 if ok else 0.0
    if acronym_a and acronym_b:
        return float(rest_a == rest_b or rest_a[0][2] == rest_b[0][2] and min(len(rest_a[0]), len(rest_b[0])) < 4)
    ga, gb = _givens(a, fa), _givens(b, fb)
    if not same_given(ga, gb) or _contradict(ga, gb):
        return 0.0
    wa, wb = sum(weight_a), sum(weight_b)
    family = min((w for t, w in zip(a, weight_a) if t == fa), default=0.0) * (1.0 if key_a == key_b else 0.9)
    shared = family
    for x, y in zip(ga, gb):
        w = min((w for t, w in [*zip(a, weight_a), *zip(b, weight_b)] if t in (x, y)), default=0.0)
        shared += w * (1.0 if x == y else 0.8)
    return shared / max(min(wa, wb), 1e-9)


def _parse(df: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for i, f, g, l in pdf.itertuples(index=False, name=None):
                t = tokens_of(f, g, l)
                if t:
                    letters = [c for x in t if x[0] != "w" for c in (x[2:] if x[0] == "a" else x[2])]
                    rows.append((i, t, " ".join(sorted(t)), letters, any(x[0] == "w" and is_kind(x[2:]) for x in t)))
            yield pd.DataFrame(rows, columns=["id", "tokens", "form", "letters", "org"])

    return df.mapInPandas(run, "id long, tokens array<string>, form string, letters array<string>, org boolean")


def token_neighbours(tokens: DataFrame, p: Params) -> DataFrame:
    """``(t, u)``, both directions, of distinct tokens that are typos of one another; tokens has t."""
    without = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: without(s, i))
    t = F.col("t")
    one = less(t)
    two = F.when(F.length(t) >= 8, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.transform(F.concat(F.array(t), one, two), lambda x: F.xxhash64(x)))
    rows = spread(tokens.filter(F.length(t) >= p.least_typo).select("t")).select("t", F.explode(keys).alias("k"))
    # Both sides rename the token, so that one shuffle serves both.
    met = rows.select(F.col("t").alias("s"), "k").join(rows.select(F.col("t").alias("u"), "k"), "k").filter("s < u AND abs(length(s) - length(u)) <= 2").select(F.col("s").alias("t"), "u").distinct()

    @F.pandas_udf(T.BooleanType())
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close_tokens(x, y) for x, y in zip(a, b)], dtype=bool)

    pairs = met.filter("levenshtein(t, u, 4) >= 0").filter(close("t", "u"))
    return pairs.unionByName(pairs.select(F.col("u").alias("t"), F.col("t").alias("u")))


def _candidates(full: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """``(a, b, t, u)``: names a < b that meet, and the tokens that are to be the same family name or place."""
    x = F.inline("ws")
    rare = full.select("id", "top", x).filter((F.length("t") >= 2) & (F.col("w") >= p.prefix_share * F.col("top"))).select("id", "t")
    met = rare.join(links, "t").select(F.col("id").alias("a"), "t", "u").join(rare.select(F.col("id").alias("b"), F.col("t").alias("u")), "u").select("a", "b", "t", "u")
    people = full.filter("NOT org")
    # Pairs of words by lead and full form; the rarer of the two is the one that is taken out as key.
    joint = lambda m, n: F.flatten(F.transform(m["c"], lambda i: F.transform(n["c"], lambda j: F.struct(F.xxhash64(F.least(i, j), F.greatest(i, j)).alias("k"), F.when(m["w"] >= n["w"], m["t"]).otherwise(n["t"]).alias("t")))))
    joints = F.flatten(F.transform("ws", lambda m: F.flatten(F.transform(F.filter("ws", lambda n: n["t"] > m["t"]), lambda n: joint(m, n)))))
    pairs = people.filter("size(ws) > 1").select("id", F.inline(joints)).distinct()
    both = pairs.select(F.col("id").alias("a"), "k", "t").join(pairs.select(F.col("id").alias("b"), "k", F.col("t").alias("u")), "k").select("a", "b", "t", "u")
    # One word with initials, or alone, asks those who have the word and a name with that letter.
    ask = people.filter("size(ws) = 1").select("id", F.col("ws")[0]["t"].alias("t"), F.coalesce(F.get("letters", F.lit(0)), F.lit("")).alias("c"))
    ask = ask.join(links, "t").select(F.col("id").alias("a"), "t", "u", "c")
    firsts = lambda m: F.flatten(F.transform(F.filter("ws", lambda n: n["t"] != m["t"]), lambda n: F.transform(F.concat(F.array(n["t"]), n["c"]), lambda v: F.substring(v, 1, 1))))
    answers = F.flatten(F.transform("ws", lambda m: F.transform(F.array_distinct(F.concat(F.array(F.lit("")), "letters", firsts(m))), lambda c: F.struct(m["t"].alias("u"), c.alias("c")))))
    asked = ask.join(people.select(F.col("id").alias("b"), F.inline(answers)), ["u", "c"]).select("a", "b", "t", "u")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("t")).otherwise(F.col("u")).alias("t"), F.when(F.col("a") < F.col("b"), F.col("u")).otherwise(F.col("t")).alias("u")]
    return met.filter("a < b").unionByName(both.filter("a < b")).unionByName(asked.filter("a <> b").select(ordered)).distinct()


def _unambiguous(good: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` without those of names with initials only whose candidates contradict each other.

    Given names are leads and full forms here, so those that agree are equal; a second name may be an initial.
    """
    ends = good.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("ga").alias("own"), F.col("gb").alias("other")), F.struct(F.col("b").alias("id"), F.col("gb").alias("own"), F.col("ga").alias("other")))))
    name = lambda i: F.get(F.split("other", " "), F.lit(i))
    word = lambda i: F.when(F.startswith(name(i), F.lit("w:")), name(i))
    one = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    longer = lambda c: F.when(name(1).isNotNull(), c)
    some = F.col("other") != ""
    vague = ends.filter("own = '' OR own LIKE 'i:%'").groupBy("id", "own").agg(
        (one(F.when(some, word(0))) & one(word(1)) & one(F.substring(name(1), 3, 1))).alias("agree"),
        (F.col("own").contains(" ") & one(longer(word(0))) & one(word(1)) & one(F.substring(name(1), 3, 1)) & (F.count(name(1)) > 0)).alias("agree2"),
    )
    kept = good
    for end, mine, other in (("a", "ga", "gb"), ("b", "gb", "ga")):
        told = vague.select(F.col("id").alias(end), F.col("own").alias(mine), "agree", "agree2")
        keep = F.col("agree").isNull() | F.col("agree") | (F.col("agree2") & F.contains(other, F.lit(" "))) | (F.col(other) == F.col(mine))
        kept = kept.join(told, [end, mine], "left").filter(keep).drop("agree", "agree2")
    return kept.select("a", "b").distinct()


def _classes(names: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """``(parsed, classes)``: the tokens of every name; each form's least name, its component and its number of links."""
    base = names.select(F.col("name_key").cast("long").alias("id"), "family", "given", "literal").filter("id IS NOT NULL").distinct()
    parsed = materialize(_parse(base), "names-parsed")
    # Names of one form may differ in the order of their words; the least order stands for all.
    reps = parsed.groupBy("form").agg(F.min("id").alias("id"), F.min(F.struct("tokens", "letters", "org")).alias("x")).select("form", "id", "x.*")
    reps = materialize(reps, "names-reps")
    words = reps.select("id", F.explode("tokens").alias("token")).filter("token LIKE 'w:%'").select("id", F.expr("substring(token, 3)").alias("t")).distinct()
    df = materialize(words.groupBy("t").agg(F.count("*").alias("df")), "names-df")
    near = materialize(token_neighbours(df, p), "names-tokens")
    n = max(reps.count(), 1)
    around = near.join(df.withColumnRenamed("t", "u"), "u").groupBy("t").agg(F.sum("df").alias("more"), F.max(F.struct("df", "u")).alias("top"))
    lead = F.when(F.col("t").isin(*sorted(_WHOLE)), F.col("t")).otherwise(F.greatest(F.struct(F.col("df"), F.col("t").alias("u")), "top")["u"])
    full_forms = F.create_map(*[F.lit(x) for short, forms in sorted(NICK.items()) for x in (short, list(forms))])
    smooth = df.join(around, "t", "left").select("t", F.log(F.lit(float(n + 1)) / (F.col("df") + F.coalesce("more", F.lit(0)))).alias("w"), lead.alias("lead"))
    smooth = materialize(smooth.withColumn("c", F.coalesce(F.try_element_at(full_forms, F.col("lead")), F.array("lead"))), "names-weights")
    weighed = words.join(smooth, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "w", "lead", "c"))).alias("ws"), F.max(F.when(F.length("t") >= 2, F.col("w"))).alias("top"))
    full = materialize(reps.join(weighed, "id").select("id", "tokens", "letters", "org", "ws", "top"), "names-full")
    links = near.filter(F.least(F.length("t"), F.length("u")) >= p.least_letters).unionByName(df.select("t", F.col("t").alias("u")))
    met = materialize(_candidates(full, links, p), "names-met")
    # One string a name, which Python takes apart once for all its pairs.
    known = F.array_join(F.transform("ws", lambda x: F.concat_ws(":", x["t"], F.round(x["w"], 4).cast("string"), x["lead"])), " ")
    side = full.select("id", F.concat_ws("\t", F.array_join("tokens", " "), known).alias("name"))
    cand = met.join(side.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(side.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")

    def verify(batches):
        taken = lru_cache(20_000)(_taken_apart)
        for pdf in batches:
            out = []
            for a, b, t, u, name_a, name_b in zip(*(pdf[c] for c in ("a", "b", "t", "u", "name_a", "name_b"))):
                (ta, va, lead_a, org_a), (tb, vb, lead_b, org_b) = taken(name_a), taken(name_b)
                org = org_a or org_b
                if similarity(ta, tb, t, u, va, vb, org_a, org_b) >= (p.organisation_score if org else p.score):
                    ga, gb = ("#" if org else " ".join(f"{x[:2]}{_full(lead.get(x[2:], x[2:]))}" for x in _givens(ts, f"w:{k}")) for ts, k, lead in ((ta, t, lead_a), (tb, u, lead_b)))
                    out.append((a, b, ga, gb))
            yield pd.DataFrame(out, columns=["a", "b", "ga", "gb"])

    verified = cand.select("a", "b", "t", "u", "name_a", "name_b")
    good = verified.mapInPandas(verify, "a long, b long, ga string, gb string").groupBy("a", "b").agg(F.min(F.struct("ga", "gb")).alias("x")).select("a", "b", "x.*")
    good = materialize(good, "names-good")
    edges = materialize(_unambiguous(good), "names-edges")
    comp = connected_components(edges, "a", "b")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = reps.select("form", F.col("id").alias("node")).join(comp, "node", "left").join(degree, "node", "left")
    return parsed, materialize(classes, "names-classes")


def name_groups(names: DataFrame, p: Params = Params()) -> DataFrame:
    """``(name_key, group_id, n_links)``, one row a name that has letters."""
    with measured_joins(names.sparkSession):
        parsed, classes = _classes(names, p)
    return (
        parsed.select(F.col("id").alias("name_key"), "form")
        .distinct()
        .join(classes, "form")
        .groupBy("name_key")
        .agg(F.min(F.coalesce("component", "node")).alias("group_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )


def name_pairs(names: DataFrame, p: Params = Params()) -> DataFrame:
    with measured_joins(names.sparkSession):
        groups = materialize(name_groups(names, p), "names-groups")
    busy = groups.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    g = groups.join(busy.hint("merge"), "group_id", "left_semi")
    a, b = (g.select("group_id", F.col("name_key").alias(f"name_key_{x}")) for x in "ab")
    return a.join(b.hint("merge"), "group_id").filter("name_key_a < name_key_b").select("name_key_a", "name_key_b")
