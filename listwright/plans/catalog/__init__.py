"""Every operator as a query over the standard tables, with the same question in SQL."""

from listwright.plans.catalog import contacts, crawls, documents, enrichment, names, pages, streets, texts

QUERIES = {
    name: query
    for module in (texts, names, streets, contacts, pages, enrichment, documents, crawls)
    for name, query in module.QUERIES.items()
}
