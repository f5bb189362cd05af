"""Training-data operators (URL filters, near-duplicate join, tokenizer, classifiers, language
model scores, mixing, vector search, WARC). Nothing else in the library imports this package;
``kestrel.llm.queries`` lists the queries that ``__spark_entry__`` registers."""
