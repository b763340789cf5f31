"""Rules: a catalogue of what they report and a predicate over fact tables for each."""
