"""Extensions for streams; batch operators do not need them."""
