"""Training-data operators (numbered 1 to 10) and their queries; nothing outside imports this subpackage."""
