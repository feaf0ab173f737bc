"""alertframe.operators"""
