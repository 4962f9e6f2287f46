"""DataFrame operators of the layers, the documents and the chat jobs."""
