"""corpusmill: curation, scoring, selection and evaluation of text corpora on Spark."""
