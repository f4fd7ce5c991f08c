"""All queries over the derived domain tables, and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gaps, graph, ingest, matching, promote, provenance, resolve, search_index, sessions, trust
from ..sources.fixtures import ctes
from . import collected, decided, records, twins
from .over import Query, over

AS_OF = datetime(1999, 6, 1)


PAIRS = ("requirements", "criteria", "requirement_certificates", "offerings", "products", "product_attributes", "companies", "company_documents")


def all_pairs(requirements, criteria, certificates, offerings, products, attributes, companies, documents) -> DataFrame:
    scores = trust.trust_scores(companies, documents)
    return matching.pairs(requirements, criteria, certificates, offerings, products, attributes, companies, documents, scores)


def batch(documents: DataFrame) -> DataFrame:
    external = F.when(F.col("doc_id") % 3 != 0, F.floor(F.col("doc_id") / 2).cast("string"))
    return documents.select(F.col("doc_id").alias("item_id"), "source", external.alias("external_id"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 50 == 7).alias("empty"))


def history(documents: DataFrame) -> DataFrame:
    rows = batch(documents.where("doc_id % 4 = 0"))
    return rows.select("source", "external_id", "content_hash")


def names(companies: DataFrame) -> DataFrame:
    n = F.col("name")
    return companies.select("company_id", text.match_name(n).alias("match_name"), text.match_domain(F.col("website")).alias("domain"), text.match_place(F.col("city")).alias("place"), text.slug(n).alias("slug"), text.squeezed(n).alias("display"))


def certificates(frame_: DataFrame) -> DataFrame:
    return frame_.select("requirement_id", "n", *[text.phrase_in(F.col("certificate"), label).alias(f"is_{kind}") for kind, label in (("iso", "iso"), ("ce", "ce"), ("bis", "bis"), ("licence", "factory license"))])


def with_term(requirements: DataFrame) -> DataFrame:
    """The product term: the family of the category, of every third requirement a colour instead, as names have it."""
    colour = F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("ring"), F.lit("bolt")), (F.col("requirement_id") % 4 + 1).cast("int"))
    return requirements.withColumn("term", F.when(F.col("requirement_id") % 3 == 0, colour).otherwise(F.split_part("category_id", F.lit("/"), F.lit(1))))


QUERIES: dict[str, Query] = {
    "names": over("companies")(names),
    "certificate_words": over("requirement_certificates")(certificates),
    "trust_scores": over("companies", "company_documents")(trust.trust_scores),
    "verified_sync": over("companies", "company_documents")(lambda c, d: trust.verified_sync(trust.trust_scores(c, d))),
    "match_candidates": over("offerings", "products")(lambda o, p: matching.candidates(o, p).select("category_id", "offering_id", "more_exist")),
    "match_ranked": over(*PAIRS)(lambda *t: matching.ranked(all_pairs(*t))),
    "match_summary": over(*PAIRS)(lambda *t: matching.summary(t[0], all_pairs(*t))),
    "gap_categories": over("search_events", "requirements", "search_candidates")(gaps.category_gaps),
    "gap_specifications": over("criteria", "requirements", "offerings", "products", "product_attributes")(gaps.specification_gaps),
    "ingest_outcomes": over("documents")(lambda d: ingest.outcomes(batch(d), history(d))),
    "ingest_rollup": over("documents")(lambda d: ingest.job_rollup(ingest.outcomes(batch(d), history(d)), "source")),
    "resolve_signals": over("observations", "companies")(lambda o, c: resolve.exact_signals(o, c).select("observation_id", "signal", "company_id")),
    "resolve_exact_decisions": over("observations", "companies", "listed_ids")(lambda o, c, i: resolve.decide(o, resolve.exact_signals(o, c).unionByName(resolve.source_signals(o, i)))),
    "resolve_decisions": over("observations", "companies", "listed_ids")(resolve.all_decisions),
    "resolve_all_decisions": over("observations", "companies")(resolve.all_decisions),
    "resolve_sources": over("observations", "listed_ids")(lambda o, i: resolve.source_signals(o, i).select("observation_id", "company_id")),
    "resolve_fuzzy": over("observations", "companies")(lambda o, c: resolve.fuzzy_signals(o, c, resolve.exact_signals(o, c)).select("observation_id", "company_id", "ratio")),
    "promote": over("observations", "companies")(promote.promote),
    "slugs": over("observations", "companies")(lambda o, c: promote.allocate_slugs(o.where("name IS NOT NULL").select(F.col("observation_id").alias("id"), "name"), c.select(text.slug(F.col("name")).alias("slug")).distinct())),
    "provenance_unpivot": over("observations")(lambda o: provenance.unpivot(o, ["name", "strong_id", "state"], ["city", "website"])),
    "conflicts": over("provenance")(provenance.conflicts),
    "field_quality": over("provenance")(lambda p: provenance.field_quality(p, AS_OF)),
    "quality_scores": over("provenance")(lambda p: provenance.quality_score(provenance.field_quality(p, AS_OF))),
    "review_queue": over("provenance")(provenance.review_queue),
    "graph_edges": over("offerings")(graph.offering_edges),
    "graph_distributors": over("offerings")(lambda o: graph.in_role(o, "distributor", "NATION_2")),
    "graph_manufacturers": over("offerings")(lambda o: graph.in_role(o, "manufacturer")),
    "graph_traversal": over("companies", "offerings", "products")(graph.traversal),
    "company_search": over("companies")(lambda c: graph.company_search(c, name="zone 1", page=1, size=10)),
    "product_search": over("products", "offerings")(lambda p, o: graph.product_search(p, o, "ring")),
    "discover": over("companies")(lambda c: graph.discover(c, "on")),
    "requirement_search": over("requirements", "companies")(lambda r, c: search_index.term_search(with_term(r), c)),
    "requirement_term_search": over("requirements", "companies")(lambda r, c: search_index.term_search(with_term(r), c, page=None)),
    "discover_terms": over("requirements", "companies")(lambda r, c: search_index.discover_terms(with_term(r), c)),
    "integrity": over("entered_offerings", "companies", "promoted_records")(graph.integrity),
    "token_reuse": over("auth_events")(sessions.token_reuse),
    "session_expiry": over("auth_events")(lambda e: sessions.session_expiry(e, 3600)),
    "keep_last": over("auth_events")(sessions.keep_last),
    "rate_limit": over("auth_events")(lambda e: sessions.rate_limit(e, 3600, 2)),
    "lockouts": over("auth_events")(sessions.lockouts),
}
ORACLES: dict[str, str] = {name: ctes(*tables) + body if tables else body for name, (tables, body) in twins.TWINS.items()}
QUERIES |= records.QUERIES | collected.QUERIES | decided.QUERIES
ORACLES |= records.ORACLES | collected.ORACLES | decided.ORACLES
