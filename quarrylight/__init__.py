"""quarrylight: a Spark-first index, retrieval and corpus engine.

Sub-packages:

``functions``  pure ``Column -> Column`` helpers (text, paths, URIs, tokens)
``sources``    file relations, ignore rules, catalogues and table views
``operators``  relational operators (lookup, rebuild, planner, search, chat)
``plans``      queries composed from the operators, with their SQL twins
``streaming``  Structured Streaming operators
``llm``        training-data operators; nothing else imports this sub-package
"""
