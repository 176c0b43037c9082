"""Spark-native selection of retrieval-training triples.

Every operator is DataFrame in / DataFrame out and keyed by an explicit
``triple_id``.  Sub-packages:

* ``sources``   – readers, writers, ingest ids, derived fixture tables
* ``functions`` – Column expressions (text cleaning, vector algebra, seeded keys)
* ``operators`` – ranking, quotas, clustering, BM25, samplers, walks, metrics
* ``plans``     – end-to-end selection and reporting jobs
* ``streaming`` – stateless operators applied to a stream of new triples
"""

from tripleselect.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
