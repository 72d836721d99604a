"""Extensions: the batch jobs of the catalog fed by streams."""
