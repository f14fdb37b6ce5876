"""Dictionary and thesaurus operators (DICT-*, THS-*, AGG-9 to AGG-17, TOP-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import text
from strandloom.sources.store import cut

# --- fixed values: patterns of alias and hypernym evidence ---------------------------------------------------------------
APPOSITION = r"([^\n,()]+?)\s*,\s*(?:also known as|a\.k\.a\.|or)\s+([^\n,()]+?)(?=[,.;:]|$)"
PARENTHESIS = r"([^\n()]+?)\s*\(([^()]+?)\)"
HYPERNYM = r"([^\n,()]+?)\s*,\s*an?\s+([^\n,.;()]+?)(?=[,.;:]|$)"
# -------------------------------------------------------------------------------------------------------------------------
SURFACE_TYPES = ("frequency", "alias", "apposition", "parenthetical")
DISTANCE = {"synonym": 0.0, "hypernym": 0.5, "hyponym": 0.5, "related": 0.75}


def evidence(facts: DataFrame) -> DataFrame:
    """DICT-3, AGG-9: frequency evidence of each entity surface, summed on its six-column key."""
    sides = facts.select("corpus_id", "doc_id", "passage_id", F.explode(F.array("head_entity", "tail_entity")).alias("surface"), "confidence")
    rows = sides.select("corpus_id", text.english_key("surface").alias("entity"), "surface", F.lit("frequency").alias("evidence_type"), F.lit("").alias("related"), "doc_id", "confidence", "passage_id")
    return upsert_evidence(rows)


def upsert_evidence(rows: DataFrame) -> DataFrame:
    """AGG-9: occurrences summed, greatest confidence, first passage, on (corpus, entity, surface, type, related, document)."""
    if "occurrences" not in rows.columns:
        rows = rows.withColumn("occurrences", F.lit(1).cast("long"))
    keys = ["corpus_id", "entity", "surface", "evidence_type", "related", "doc_id"]
    return rows.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.max("confidence").alias("confidence"), F.min("passage_id").alias("passage_id"))


def text_evidence(passages: DataFrame) -> DataFrame:
    """DICT-3: (passage_id, kind, left, right) of the alias and hypernym patterns, matched case-blind."""
    out = None
    for kind, p in (("apposition", APPOSITION), ("parenthetical", PARENTHESIS), ("hypernym", HYPERNYM)):
        # a match can only begin where its first run of characters does; later starts in the run would end alike
        p = (r"(?:\G|(?<![^\n()]))" if kind == "parenthetical" else r"(?:\G|(?<![^\n,()]))") + p
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)).alias("l"), F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(2)).alias("r"))
        rows = passages.select("passage_id", F.explode(pairs).alias("m")).select("passage_id", F.lit(kind).alias("kind"), F.trim("m.l").alias("left"), F.trim("m.r").alias("right"))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve_pairs(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """DICT-3: an alias pair belongs to the side that occurs more (ties: the lower name); the other side is the surface."""
    c = counts.select("entity", "n")
    j = pairs.withColumn("l", text.english_key("left")).withColumn("r", text.english_key("right"))
    j = j.join(c.select(F.col("entity").alias("l"), F.col("n").alias("nl")), "l", "left").join(c.select(F.col("entity").alias("r"), F.col("n").alias("nr")), "r", "left")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    left = (nl > nr) | ((nl == nr) & (F.col("l") <= F.col("r")))
    some = (nl > 0) | (nr > 0)
    return j.filter(some).select("passage_id", "kind", F.when(left, F.col("l")).otherwise(F.col("r")).alias("entity"), F.when(left, F.col("right")).otherwise(F.col("left")).alias("surface"))


def dictionary(ev: DataFrame) -> DataFrame:
    """AGG-10: per entity its canonical form (most frequent surface, ties by surface), aliases that differ from it, frequency
    (of frequency evidence) and greatest confidence."""
    s = ev.filter(F.col("evidence_type").isin(*SURFACE_TYPES)).groupBy("corpus_id", "entity", "surface").agg(F.sum("occurrences").alias("n"))
    first = Window.partitionBy("corpus_id", "entity").orderBy(F.col("n").desc(), "surface")
    s = s.withColumn("rn", F.row_number().over(first)).withColumn("canonical", F.first("surface").over(first))
    other = F.when(text.english_key("surface") != text.english_key("canonical"), F.col("surface"))
    forms = s.groupBy("corpus_id", "entity").agg(F.max(F.when(F.col("rn") == 1, F.col("surface"))).alias("canonical"), F.array_sort(F.collect_set(other)).alias("aliases"))
    totals = ev.groupBy("corpus_id", "entity").agg(F.sum(F.when(F.col("evidence_type") == "frequency", F.col("occurrences")).otherwise(0)).alias("frequency"), F.max("confidence").alias("confidence"))
    return forms.join(totals, ["corpus_id", "entity"]).withColumn("term_id", F.concat_ws(":", F.lit("lex"), "corpus_id", "entity"))


def domain_categories(facts: DataFrame) -> DataFrame:
    """AGG-11, SET-1: the commonest type (lower case) of each entity over both sides of its facts; ties by name."""
    sides = facts.select(text.english_key("head_entity").alias("entity"), F.lower("head_type").alias("type")).unionAll(facts.select(text.english_key("tail_entity").alias("entity"), F.lower("tail_type").alias("type")))
    n = sides.filter("type <> ''").groupBy("entity", "type").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("entity").orderBy(F.col("n").desc(), "type")
    return n.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("entity", F.col("type").alias("category"))


def stopword_entities(entries: DataFrame, share: float = 0.01) -> DataFrame:
    """AGG-12: the most frequent hundredth of the entities, rounded down; ties by name. Ranks come from a range-sorted take of that length."""
    n = entries.count()
    return entries.orderBy(F.col("frequency").desc(), "entity").limit(int(n * share)).select("entity")


def ambiguous_surfaces(ev: DataFrame) -> DataFrame:
    """AGG-13: surfaces (lower case) of more than one entity."""
    return ev.groupBy(F.lower("surface").alias("surface")).agg(F.countDistinct("entity").alias("n")).filter("n > 1").select("surface")


def cooccurring(facts: DataFrame, least_passages: int = 2, similarity: float = 0.8) -> DataFrame:
    """AGG-15: pairs of entities in two passages or more that share a type and whose terms have a Jaccard of at least 0.8.

    Pairs are made within (passage, type), so that entities of different types never meet.
    """
    sides = facts.select("passage_id", F.explode(F.array(F.struct(text.english_key("head_entity").alias("e"), F.lower("head_type").alias("t")), F.struct(text.english_key("tail_entity").alias("e"), F.lower("tail_type").alias("t")))).alias("s")).select("passage_id", "s.e", "s.t").distinct()
    a, b = sides.select("passage_id", F.col("e").alias("a"), "t"), sides.select("passage_id", F.col("e").alias("b"), "t")
    pairs = a.join(b, ["passage_id", "t"]).filter("a < b").groupBy("a", "b").agg(F.countDistinct("passage_id").alias("n"))
    return pairs.filter((F.col("n") >= least_passages) & (text.jaccard(text.term_set("a"), text.term_set("b")) >= similarity))


def suggest_candidates(terms: DataFrame, threshold: int = 3) -> DataFrame:
    """AGG-16: pending terms seen ``threshold`` times or more, confidence min(1, n / threshold)."""
    n = terms.select(F.trim("term").alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    return n.filter(F.col("frequency") >= threshold).withColumn("confidence", F.least(F.lit(1.0), F.col("frequency") / threshold)).withColumn("status", F.lit("pending"))


def api_dictionary(papers: DataFrame, corpus: str) -> DataFrame:
    """AGG-17, TXT-19: (domain, text) papers as entries: frequency = papers with the term, confidence min(1, .4 + .6 f / papers)."""
    t = papers.select("paper_id", "domain", F.explode(text.api_terms("text")).alias("term"))
    f = t.groupBy("domain", "term").agg(F.countDistinct("paper_id").alias("frequency"))
    n = papers.groupBy("domain").agg(F.countDistinct("paper_id").alias("papers"))
    form = text.title_case(text.normalize_api_term("term"))
    out = f.join(F.broadcast(n), "domain").withColumn("canonical", form)
    term_id = F.concat(F.lit(f"api:{corpus}:"), F.col("domain"), F.lit(":"), F.substring(F.sha1(F.col("canonical").cast("binary")), 1, 12))
    return out.select(term_id.alias("term_id"), "domain", "term", "canonical", "frequency", F.least(F.lit(1.0), 0.4 + 0.6 * F.col("frequency") / F.col("papers")).alias("confidence"))


# --- matching --------------------------------------------------------------------------------------------------------


def phrases(body: Column, longest: int) -> Column:
    """All word n-grams up to ``longest`` words of a text, in lower case: what a phrase delimited by word boundaries can equal."""
    w = F.filter(F.split(F.lower(body), r"[^a-z0-9_#'-]+"), lambda x: x != "")

    made = [w]
    for k in range(2, longest + 1):  # by zipping neighbours: slicing in a lambda would copy the array for every place
        n = F.greatest(F.size(w) - (k - 1), F.lit(0))
        made.append(F.zip_with(F.slice(made[-1], 1, n), F.slice(w, k, n), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(*made))


def match_phrases(texts: DataFrame, entries: DataFrame, key: str = "doc_id", longest: int = 4) -> DataFrame:
    """DICT-1, JN-12: entries (term, canonical, aliases, frequency, confidence) found in texts as delimited phrases.

    The texts' phrases are looked up by equality instead of searching for every entry; an entry's matched form is its first
    in the order term, canonical, aliases. Boost = 1 + confidence + min(frequency, 10) / 10. Texts are dealt into words once,
    and phrases longer than any entry's are not made.
    """
    forms = entries.select("term", "frequency", "confidence", F.posexplode(F.concat(F.array("term", "canonical"), "aliases")).alias("pos", "form")).withColumn("form", F.lower(F.trim("form"))).filter("form <> ''")
    forms = forms.groupBy("term", "frequency", "confidence", "form").agg(F.min("pos").alias("pos"))
    found = texts.select(key, F.explode(phrases(F.coalesce("text", F.lit("")), longest)).alias("form")).join(forms, "form")
    hit = found.groupBy(key, "term", "frequency", "confidence").agg(F.min_by("form", "pos").alias("matched"))
    return hit.withColumn("boost", 1 + F.col("confidence") + F.least(F.col("frequency"), F.lit(10)) / 10)


# --- thesaurus -------------------------------------------------------------------------------------------------------


def relation_id(corpus, source, target, kind) -> Column:
    return F.concat_ws(":", F.lit("rel"), corpus, text.english_key(source), text.english_key(target), kind)


def recompute_thesaurus(entries: DataFrame, alias_evidence: DataFrame, hypernyms: DataFrame, stop: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """DICT-6: synonyms of aliases (weight 1), then of alias evidence, then hypernyms; the last writer of a relation wins.

    Relations to itself, at stop entities or (synonyms) ambiguous surfaces are left out.
    """
    cols = ["corpus_id", "source", "target", "relation_type", "weight", "bidirectional", "priority"]
    a = entries.select("corpus_id", F.col("canonical").alias("source"), F.explode("aliases").alias("target"), F.lit("synonym").alias("relation_type"), F.lit(1.0).alias("weight"), F.lit(True).alias("bidirectional"), F.lit(0).alias("priority"))
    b = alias_evidence.select("corpus_id", F.col("entity").alias("source"), F.col("surface").alias("target"), F.lit("synonym").alias("relation_type"), F.col("confidence").alias("weight"), F.lit(True).alias("bidirectional"), F.lit(1).alias("priority"))
    h = hypernyms.select("corpus_id", F.col("entity").alias("source"), F.col("hypernym").alias("target"), F.lit("hypernym").alias("relation_type"), F.col("confidence").alias("weight"), F.lit(False).alias("bidirectional"), F.lit(2).alias("priority"))
    rows = a.select(cols).unionByName(b.select(cols)).unionByName(h.select(cols)).withColumn("s", text.english_key("source")).withColumn("t", text.english_key("target")).filter("s <> t")
    for side in "st":
        rows = rows.join(stop.select(F.col("entity").alias(side)), side, "left_anti")
    amb = ambiguous.select(F.col("surface").alias("t"), F.lit(True).alias("amb"))
    rows = rows.join(amb, "t", "left").filter(~((F.col("relation_type") == "synonym") & F.coalesce("amb", F.lit(False)))).drop("amb")
    rows = rows.withColumn("relation_id", relation_id("corpus_id", "s", "t", "relation_type"))
    return rows.groupBy("relation_id").agg(F.max_by(F.struct("corpus_id", "source", "target", "relation_type", "weight", "bidirectional"), F.struct("priority", "weight", "source", "target")).alias("r")).select("relation_id", "r.*")


def prune_aliases(entries: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """DICT-7: entries without ambiguous aliases, with ``removed``, the number that went. The join is on single aliases."""
    each = entries.select("term_id", F.explode("aliases").alias("alias")).join(ambiguous.select(F.col("surface").alias("k")), F.lower("alias") == F.col("k"), "left_semi")
    gone = each.groupBy("term_id").agg(F.collect_set("alias").alias("gone"))
    j = entries.join(gone, "term_id", "left")
    left = F.array_except("aliases", F.coalesce("gone", F.array().cast("array<string>")))
    return j.withColumn("removed", F.size("aliases") - F.size(left)).withColumn("aliases", left).drop("gone")


def relations_of(relations: DataFrame, term: str) -> DataFrame:
    """THS-1: relations at a term on either side, whatever the case; heaviest first."""
    k = term.strip().lower()
    return relations.filter((F.lower("source") == k) | (F.lower("target") == k)).orderBy(F.col("weight").desc(), "relation_id")


def normalize_terms(terms: DataFrame, entries: DataFrame, relations: DataFrame) -> DataFrame:
    """THS-2: (term, normalized): the dictionary's canonical form, else the first synonym's target, else its source, else the term."""
    k = F.lower(F.trim("term"))
    forms = entries.select(F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical"), "aliases"), lambda x: F.lower(x)))).alias("k"), "canonical", "frequency")
    canon = forms.groupBy("k").agg(F.max_by("canonical", F.struct("frequency", "canonical")).alias("canonical"))
    syn = relations.filter("relation_type = 'synonym'")
    fwd = syn.groupBy(F.lower("source").alias("k")).agg(F.max_by("target", F.struct("weight", "target")).alias("to"))
    back = syn.groupBy(F.lower("target").alias("k")).agg(F.max_by("source", F.struct("weight", "source")).alias("back"))
    j = terms.select("term", k.alias("k")).join(canon, "k", "left").join(fwd, "k", "left").join(back, "k", "left")
    return j.select("term", F.coalesce("canonical", "to", "back", "term").alias("normalized"))


def expand_query(tokens: DataFrame, relations: DataFrame, synonyms: int = 3, hypernyms: int = 2) -> DataFrame:
    """THS-3, TOP-13: (query_id, pos, token) with related terms, at most three synonyms and two hypernyms per query; a term that
    is asked for already or was added before is skipped."""
    r = relations.filter(F.col("relation_type").isin("synonym", "hypernym"))
    t = tokens.select("query_id", "pos", F.lower("token").alias("k"))
    out = r.select(F.lower("source").alias("k"), F.lower("target").alias("added"), "relation_type", "weight").unionByName(r.filter("bidirectional").select(F.lower("target").alias("k"), F.lower("source").alias("added"), "relation_type", "weight"))
    found = t.join(out, "k").groupBy("query_id", "relation_type", "added").agg(F.min("pos").alias("pos"), F.max("weight").alias("weight"))
    found = found.join(t.select("query_id", F.col("k").alias("added")), ["query_id", "added"], "left_anti")
    once = Window.partitionBy("query_id", "added").orderBy(F.col("relation_type").desc())
    found = found.withColumn("o", F.row_number().over(once)).filter("o = 1")
    w = Window.partitionBy("query_id", "relation_type").orderBy("pos", F.col("weight").desc(), "added")
    limit = F.when(F.col("relation_type") == "synonym", synonyms).otherwise(hypernyms)
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).select("query_id", "relation_type", "added")


def suggest_synonyms(entries: DataFrame) -> DataFrame:
    """THS-4: (canonical, alias) pairs."""
    return entries.select("canonical", F.explode("aliases").alias("alias"))


def has_cycle(relations: DataFrame) -> bool:
    """THS-5: whether hypernym edges (hyponym edges reversed) contain a cycle: leaves are taken off until nothing is left."""
    h = relations.filter("relation_type = 'hypernym'").select(F.lower("source").alias("a"), F.lower("target").alias("b"))
    e = h.unionByName(relations.filter("relation_type = 'hyponym'").select(F.lower("target").alias("a"), F.lower("source").alias("b"))).distinct()
    e, n = cut(e, "hypernyms"), -1
    while True:
        left = cut(e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "hypernyms")
        m = left.count()
        if m == 0 or m == n:
            return m > 0
        e, n = left, m


def distance(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """THS-6: 0 for synonyms, a half for hypernyms and hyponyms, three quarters for related terms, 1 for none; least over both ways."""
    d = F.coalesce(*[F.when(F.col("relation_type") == k, F.lit(v)) for k, v in DISTANCE.items()])
    r = relations.select(F.lower("source").alias("x"), F.lower("target").alias("y"), d.alias("d"))
    r = r.unionByName(r.select(F.col("y").alias("x"), F.col("x").alias("y"), "d")).groupBy("x", "y").agg(F.min("d").alias("d"))
    return pairs.select("a", "b", F.lower("a").alias("x"), F.lower("b").alias("y")).join(r, ["x", "y"], "left").select("a", "b", F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.coalesce("d", F.lit(1.0))).alias("distance"))


def incremental(ev: DataFrame, doc, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DICT-4: evidence with a document's rows replaced, and the entities whose entries must be made again."""
    old = ev.filter(F.col("doc_id") == doc)
    affected = old.select("entity").union(new.select("entity")).distinct()
    return ev.filter(F.col("doc_id") != doc).unionByName(new), affected


def normalize_entities(facts: DataFrame, normal: DataFrame) -> DataFrame:
    """EXT-6: heads and tails by their normalized terms (term, normalized)."""
    out = facts
    for side in ("head_entity", "tail_entity"):
        out = out.join(normal.select(F.col("term").alias(side), F.col("normalized").alias(f"n_{side}")), side, "left").withColumn(side, F.coalesce(f"n_{side}", side)).drop(f"n_{side}")
    return out.select(facts.columns)


def hints(matches: DataFrame, least: float = 0.7) -> DataFrame:
    """FLT-6: matches confident enough to be shown."""
    return matches.filter(F.col("confidence") >= least)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "Window", "F", "text", "cut")]
