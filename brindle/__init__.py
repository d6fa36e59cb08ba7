"""brindle: catalogue queries, retrieval and text preparation as Spark DataFrame plans."""
