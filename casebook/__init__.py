"""casebook: profile, describe, vectorise, classify and triage labelled free text on Spark.

Everything is a ``DataFrame -> DataFrame`` function:

* ``casebook.sources``    scans, sinks, staging in the shared folder, stand-in tables
* ``casebook.functions``  column expressions (text cleaning, hashing)
* ``casebook.operators``  profiling, labels, series, distributions, association, lexicon,
  sampling, augmentation, TF-IDF, classifiers, evaluation
* ``casebook.plans``      the three end-to-end flows and the query catalogue
"""
