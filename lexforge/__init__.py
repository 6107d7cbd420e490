"""lexforge: DataFrame operators for question/answer authoring data and text corpora."""
