"""Training-data operators over text, URLs, vectors and conversations.

One module per operator; ``queries`` registers one query per operator. Nothing
else in the library imports this subpackage.
"""
