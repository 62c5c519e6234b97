"""Readers and writers of the file formats of sequence binning."""
