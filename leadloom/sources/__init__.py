"""Tables, stored pages, payloads and the matching sinks."""
