"""quillspan: DataFrame operators for building, labelling and evaluating speech-and-text corpora."""

__version__ = "0.1.0"
