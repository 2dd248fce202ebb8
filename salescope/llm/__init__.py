"""Training-data operators: toxicity tagging, quality, mixing, sharding,
de-duplication, decontamination, language-model scores, secrets and url
reputation over tables of documents and pages.  Nothing outside this
subpackage imports it."""
